"""Dates and durations: literals are folded while planning, columns stay expressions."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of durations with their seconds; a year has 365 days and a month 30 (fixed values).
UNITS = {
    "years": 31536000, "year": 31536000, "yrs": 31536000, "yr": 31536000, "y": 31536000, "months": 2592000, "month": 2592000, "mos": 2592000, "mo": 2592000,
    "weeks": 604800, "week": 604800, "wks": 604800, "wk": 604800, "w": 604800, "days": 86400, "day": 86400, "d": 86400,
    "hours": 3600, "hour": 3600, "hrs": 3600, "hr": 3600, "h": 3600, "minutes": 60, "minute": 60, "mins": 60, "min": 60, "m": 60,
    "seconds": 1, "second": 1, "secs": 1, "sec": 1, "s": 1,
}
_NUMBER = r"-?\d+(?:\.\d+)?"
_PAIR = rf"({_NUMBER}) *({'|'.join(sorted(UNITS, key=len, reverse=True))})"
_ALL = rf"^{_PAIR}(?:(?: *, *| *){_PAIR})*$"
_ISO = r"^([+-]?)P(?=.)(?:(\d+(?:\.\d+)?)Y)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)W)?(?:(\d+(?:\.\d+)?)D)?(?:T(?=.)(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
_ISO_SECONDS = (31536000, 2592000, 604800, 86400, 3600, 60, 1)


def split_duration(text: str) -> tuple[int, float] | None:
    """Whole calendar months and remaining seconds of a duration text; None when malformed."""
    text = text.strip()
    if not re.match(_ISO, text, re.I) and not re.match(_ALL, text, re.I):
        return None
    months, rest = 0, 0.0
    for n, unit in _pairs(text):
        if unit in (31536000, 2592000):
            whole = int(n)
            months += whole * (12 if unit == 31536000 else 1)
            n -= whole
        rest += n * unit
    return months, rest


def seconds(text: str) -> float | None:
    """Seconds of a duration text, by the fixed lengths of years and months."""
    got = split_duration(text)
    return None if got is None else float(sum(n * u for n, u in _pairs(text)))


def _pairs(text: str) -> list[tuple[float, int]]:
    if m := re.match(_ISO, text.strip(), re.I):
        return [((-1 if m[1] == "-" else 1) * float(v), u) for v, u in zip(m.groups()[1:], _ISO_SECONDS) if v is not None]
    return [(float(n), UNITS[u.lower()]) for n, u in re.findall(_PAIR, text, re.I)]


def seconds_of(c: Column) -> Column:
    """Seconds of a column of duration texts in words; absent where malformed. ISO texts are read as literals only."""
    low = F.lower(F.trim(c))
    n, u = F.regexp_extract_all(low, F.lit(_PAIR), 1), F.regexp_extract_all(low, F.lit(_PAIR), 2)
    units = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    total = F.aggregate(F.zip_with(n, u, lambda a, b: a.cast("double") * units[b]), F.lit(0.0), lambda s, x: s + x)
    return F.when(low.rlike(_ALL), total)


def named_date(text: str, today: str | None) -> str | None:
    """ISO form of a named point or a date text, upper or lower case, trimmed; None for anything else. `now` is the
    instant, with milliseconds; the others are days. today: the day, or the instant, that they count from."""
    text = text.strip()
    if text.lower() == "now" and (today is None or len(today) > 10):
        at = dt.datetime.fromisoformat(today) if today else dt.datetime.now(dt.timezone.utc)
        return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
    today = today[:10] if today else None
    day = dt.date.fromisoformat(today) if today else dt.datetime.now(dt.timezone.utc).date()
    month = day.replace(day=1)
    after = (month + dt.timedelta(days=32)).replace(day=1)
    points = {
        "now": day, "today": day, "yesterday": day - dt.timedelta(1), "tomorrow": day + dt.timedelta(1),
        "sow": day - dt.timedelta(day.weekday()), "eow": day + dt.timedelta(6 - day.weekday()), "som": month, "eom": after - dt.timedelta(1),
        "soy": day.replace(month=1, day=1), "eoy": day.replace(month=12, day=31),
    }
    if text.lower() in points:
        return points[text.lower()].isoformat()
    try:
        return text if dt.date.fromisoformat(text[:10]) and len(text) >= 10 else None
    except ValueError:
        return None


def moved(c: Column, t: T.DataType, by: str | float | int | Column | None, sign: int) -> Column:
    """A date moved by seconds or a duration text. Timestamps stay timestamps; texts of a day stay such a text when
    whole days are added and else become a UTC one."""
    months, rest = F.lit(0), None
    if isinstance(by, str):
        got = split_duration(by)
        if got is None:
            return F.lit(None).cast(t)
        months, rest = F.lit(sign * got[0]), F.lit(sign * got[1])
    elif by is None or isinstance(by, bool):
        return F.lit(None).cast(t)
    else:
        rest = sign * (by if isinstance(by, Column) else F.lit(by)).cast("double")
    ts = F.try_to_timestamp(c.cast("string")) if isinstance(t, T.StringType) else c.cast("timestamp")
    time = F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))
    out = F.timestamp_micros((F.unix_micros(F.add_months(ts, months).cast("timestamp")) + time + F.round(rest * 1e6).cast("long")))
    if not isinstance(t, T.StringType):
        return out.cast(t) if isinstance(t, T.TimestampNTZType) else out
    whole = (F.length(c) == 10) & (rest % 86400 == 0)
    return F.when(whole, F.date_format(out, "yyyy-MM-dd")).when(F.unix_micros(out) % 1_000_000 == 0, F.date_format(out, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(out, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def until(a: Column, b: Column) -> Column:
    """Seconds from one date to another."""
    at = lambda c: F.unix_micros(F.try_to_timestamp(c.cast("string")))
    return (at(b) - at(a)) / 1e6


def _parts(c: Column) -> tuple[Column, list[Column], Column]:
    n = F.abs(c.cast("double"))
    whole = F.floor(n)
    s = F.round(n - whole + whole % 60, 3)
    return n, [F.floor(whole / 86400), F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60], s


def _short(s: Column) -> Column:
    return F.when(s == F.floor(s), s.cast("long").cast("string")).otherwise(s.cast("string"))


def dur_text(c: Column) -> Column:
    """`1d 2h 3m 4s`, zero parts left out."""
    n, parts, s = _parts(c)
    words = [F.when(p > 0, F.concat(p.cast("string"), F.lit(u))) for p, u in zip(parts, "dhm")] + [F.when(s > 0, F.concat(_short(s), F.lit("s")))]
    return F.when(n == 0, "0s").when(c.isNotNull(), F.concat(F.when(c < 0, "-").otherwise(""), F.concat_ws(" ", *words)))


def dur_iso(c: Column) -> Column:
    """ISO form in days, hours, minutes and seconds."""
    n, (d, h, m), s = _parts(c)
    word = lambda p, u: F.when(p > 0, F.concat(p.cast("string"), F.lit(u))).otherwise("")
    time = F.concat(word(h, "H"), word(m, "M"), F.when(s > 0, F.concat(_short(s), F.lit("S"))).otherwise(""))
    return F.when(n == 0, "PT0S").when(c.isNotNull(), F.concat(F.when(c < 0, "-").otherwise(""), F.lit("P"), word(d, "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise("")))
