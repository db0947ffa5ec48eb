"""Typed, absent-safe scalar semantics as Column expressions. NULL is the absent value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.NumericType,)


def kind(t: T.DataType) -> str:
    """The language's kind of a Spark type."""
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "string"
    return {T.BooleanType: "bool", T.ArrayType: "array", T.NullType: "absent"}.get(type(t), "object")


def truthy(c: Column, t: T.DataType) -> Column:
    """False for absent, false, 0, "" and empty collections."""
    k = kind(t)
    if k == "absent":
        return F.lit(False)
    test = {"bool": lambda: c, "number": lambda: c != 0, "string": lambda: c.cast("string") != "", "array": lambda: F.size(c) > 0}.get(k, c.isNotNull)()
    return F.coalesce(test, F.lit(False))


def equal(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Strict typed equality; absent equals absent."""
    ka, kb = kind(ta), kind(tb)
    if ka == kb or "absent" in (ka, kb):
        return a.eqNullSafe(b)
    return a.isNull() & b.isNull()


def compare(op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Order of numbers or strings; any absent or mixed pair is false."""
    if kind(ta) != kind(tb) or kind(ta) not in ("number", "string"):
        return F.lit(False)
    test = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.coalesce(test, F.lit(False))


def text(c: Column, t: T.DataType) -> Column:
    """String form: whole numbers without fraction."""
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """Doubles; absent propagates; division by zero is absent."""
    a, b = a.cast("double"), b.cast("double")
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b)}[op]()


def size(c: Column, t: T.DataType) -> Column:
    k = kind(t)
    if k == "absent":
        return F.lit(0)
    return F.coalesce(F.size(c) if k == "array" or isinstance(t, T.MapType) else F.char_length(c.cast("string")) if k == "string" else F.lit(0), F.lit(0))


def contains(c: Column, t: T.DataType, v: Column) -> Column:
    """Array membership (absent equals absent) or substring."""
    if kind(t) == "array":
        return F.coalesce(F.exists(c, lambda e: e.eqNullSafe(v)), F.lit(False))
    return F.coalesce(F.contains(c.cast("string"), v.cast("string")), F.lit(False))


_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_ISO_TEXT = r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?"


def in_text_range(x: Column, t: T.DataType, text: Column) -> Column:
    """Whether a number or text lies in the range that a text like `1..5`, `..5` or `2024-01-01...2024-02-01` writes."""
    k = kind(t)
    if k not in ("number", "string"):
        return F.lit(False)
    bound = _NUMBER if k == "number" else _ISO_TEXT
    pattern = rf"^\s*({bound})?\s*(\.{{2,3}})\s*({bound})?\s*$"
    lo, dots, hi = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    cast = (lambda c: c.cast("double")) if k == "number" else (lambda c: c)
    below = F.when(dots == "...", x < cast(F.nullif(hi, F.lit("")))).otherwise(x <= cast(F.nullif(hi, F.lit(""))))
    return F.coalesce((dots != "") & ((lo != "") | (hi != "")) & ((lo == "") | (x >= cast(F.nullif(lo, F.lit(""))))) & ((hi == "") | below) & x.isNotNull(), F.lit(False))


#: Tokens of date patterns and their Spark pattern.
DATE_TOKENS = ("yyyy", "MMM", "EEE", "MM", "dd", "HH", "mm", "ss")


def date_format(c: Column, pattern: str) -> Column:
    import re

    parts = [p for p in re.split("(" + "|".join(DATE_TOKENS) + ")", pattern) if p]
    return F.concat(*(F.date_format(c, p) if p in DATE_TOKENS else F.lit(p) for p in parts))


METHODS = {
    "lower": lambda c, t: F.lower(text(c, t)),
    "upper": lambda c, t: F.upper(text(c, t)),
    "size": size,
    "contains": contains,
    "startsWith": lambda c, t, v: F.coalesce(F.startswith(c.cast("string"), v), F.lit(False)),
    "endsWith": lambda c, t, v: F.coalesce(F.endswith(c.cast("string"), v), F.lit(False)),
    "year": lambda c, t: F.year(c),
    "month": lambda c, t: F.month(c),
    "day": lambda c, t: F.day(c),
    "weekday": lambda c, t: F.weekday(c) + 1,
    "hour": lambda c, t: F.hour(c),
    "minute": lambda c, t: F.minute(c),
    "second": lambda c, t: F.second(c),
    "date": lambda c, t: F.date_format(c, "yyyy-MM-dd"),
}
