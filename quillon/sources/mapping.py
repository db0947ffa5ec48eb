"""Authored mappings: the front matter of Markdown, and documents that are YAML or JSON as a whole, as rows of properties.

The YAML that is read has block and flow mappings and lists, quoted and plain scalars of the core schema, literal and folded
blocks, and comments. Anchors, aliases, tags and several documents are not read: such a text has no rows, like a malformed one.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'"%@`?-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*))?$""")
_NUMBER = re.compile(r"[-+]?(\d+|\d*\.\d+|\d+\.\d*)([eE][-+]?\d+)?$")


class Malformed(ValueError):
    """A text that is no mapping in the YAML that is read."""


def scalar(text: str) -> object:
    """A plain scalar of the core schema."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text[0] in "tT"
    if _NUMBER.match(text):
        return int(text) if re.fullmatch(r"[-+]?\d+", text) else float(text)
    if re.fullmatch(r"0x[0-9a-fA-F]+|0o[0-7]+", text):
        return int(text, 0)
    if m := re.fullmatch(r"([-+]?)\.(inf|Inf|INF|nan|NaN|NAN)", text):
        return math.nan if m[2].lower() == "nan" else -math.inf if m[1] == "-" else math.inf
    return text


def _bare(line: str) -> str:
    """A line without its comment and the space around it."""
    quote = ""
    for i, ch in enumerate(line):
        if quote:
            quote = "" if ch == quote and not (quote == '"' and line[i - 1] == "\\") else quote
        elif ch in "'\"" and (i == 0 or line[i - 1] in " \t[{,:-"):
            quote = ch
        elif ch == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].strip()
    return line.strip()


class _Flow:
    """[lists], {mappings} and quoted scalars on one line."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def whole(self) -> object:
        out = self.value("")
        if self.text[self.at :].strip():
            raise Malformed(self.text)
        return out

    def skip(self) -> str:
        while self.at < len(self.text) and self.text[self.at] in " \t\n":
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self, ends: str) -> object:
        ch = self.skip()
        if ch and ch in "[{":
            return self.items("]" if ch == "[" else "}")
        if ch == '"':
            m = re.compile(r'"(?:[^"\\]|\\.)*"').match(self.text, self.at)
            try:
                out = json.loads(m[0].replace("\n", " ")) if m else None
            except ValueError:
                m = None
        elif ch == "'":
            m = re.compile(r"'((?:[^']|'')*)'").match(self.text, self.at)
            out = m and m[1].replace("''", "'")
        elif ch and ch in "&*!|>%@`":
            raise Malformed(self.text)
        else:
            m = re.compile(rf"(?:(?!:\s)[^{re.escape(ends)}])*" if ends else r"[\s\S]*").match(self.text, self.at)
            out = scalar(m[0].strip().rstrip(":") if ends == ",}" and m[0].strip().endswith(":") else m[0].strip())
        if m is None:
            raise Malformed(self.text)
        self.at = m.end()
        return out

    def items(self, end: str) -> object:
        self.at += 1
        out: dict | list = [] if end == "]" else {}
        while self.skip() != end:
            one = self.value("," + end)
            if isinstance(out, list):
                out.append(one)
            else:
                if self.skip() == ":":
                    self.at += 1
                    put(out, one, self.value("," + end))
                else:
                    put(out, one, None)
            if self.skip() == ",":
                self.at += 1
            elif self.skip() != end:
                raise Malformed(self.text)
        self.at += 1
        return out


def put(out: dict, key: object, value: object) -> None:
    name = "" if key is None else key if isinstance(key, str) else plain(key)
    if name in out:
        raise Malformed(f"{name} twice")
    out[name] = value


class _Yaml:
    def __init__(self, text: str):
        self.raw = text.replace("\r\n", "\n").split("\n")
        self.at = 0
        #: A list item's rest, read as a line of its own: (indent, text).
        self.pending: tuple[int, str] | None = None

    def peek(self) -> tuple[int, str] | None:
        """Indent and text of the next line that holds something."""
        if self.pending:
            return self.pending
        while self.at < len(self.raw):
            line = self.raw[self.at]
            if bare := _bare(line):
                pad = line[: len(line) - len(line.lstrip())]
                if "\t" in pad:
                    raise Malformed(line)
                return len(pad), bare
            self.at += 1
        return None

    def take(self) -> None:
        self.pending = None
        self.at += 1

    def node(self, indent: int) -> object:
        first = self.peek()
        if first[1] == "-" or first[1].startswith("- "):
            return self.sequence(indent)
        return self.mapping(indent) if _KEY.match(first[1]) else self.inline(indent - 1, first[1])

    def sequence(self, indent: int) -> list:
        out = []
        while (line := self.peek()) and line[0] == indent and (line[1] == "-" or line[1].startswith("- ")):
            rest = line[1][1:].lstrip()
            if not rest:
                self.take()
                out.append(self.below(indent))
            elif rest == "-" or rest.startswith("- ") or _KEY.match(rest) and rest[0] not in "[{":
                self.pending = (indent + len(line[1]) - len(rest), rest)
                out.append(self.node(self.pending[0]))
            else:
                out.append(self.inline(indent, rest))
        return out

    def below(self, indent: int, or_list: bool = False) -> object:
        line = self.peek()
        if line and (line[0] > indent or or_list and line[0] == indent and (line[1] == "-" or line[1].startswith("- "))):
            return self.node(line[0])
        return None

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while (line := self.peek()) and line[0] == indent and (m := _KEY.match(line[1])):
            key = _Flow(m[1]).whole() if m[1][0] in "'\"" else scalar(m[1])
            if m[2]:
                value = self.inline(indent, m[2])
            else:
                self.take()
                value = self.below(indent, or_list=True)
            put(out, key, value)
        if line and line[0] >= indent and not (line[0] == indent and line[1].startswith("-")):
            raise Malformed(line[1])
        return out

    def inline(self, indent: int, text: str) -> object:
        """A value that begins on this line; deeper lines go on with it."""
        self.take()
        if m := re.fullmatch(r"([|>])(\d?)([-+]?)(\d?)", text):
            return self.block(indent, *m.groups())
        while (line := self.peek()) and line[0] > indent:
            text += " " + line[1]
            self.take()
        if text[0] not in "[{'\"" and (": " in text or text.endswith(":")):
            raise Malformed(text)
        return _Flow(text).whole()

    def block(self, indent: int, style: str, a: str, chomp: str, b: str) -> str:
        lines = []
        depth = indent + int(a or b) if a or b else None
        while self.at < len(self.raw):
            line = self.raw[self.at]
            pad = len(line) - len(line.lstrip(" "))
            if line.strip():
                depth = pad if depth is None else depth
                if pad < depth or pad <= indent:
                    break
            lines.append(line[depth or 0 :] if line.strip() else "")
            self.at += 1
        body = "\n".join(lines)
        end = len(body) - len(body.rstrip("\n"))
        text = body.rstrip("\n")
        if style == ">":
            text = re.sub(r"(?<=[^\n])\n(\n*)(?=[^\n\s])", lambda m: m[1] or " ", text)
        return text + ("" if chomp == "-" or not text else "\n" * (end + 1) if chomp == "+" else "\n")


def read_yaml(text: str) -> dict:
    """The mapping that a YAML text is."""
    y = _Yaml(re.sub(r"\A(?:%[^\n]*\n)*---[ \t]*\n", "", text))
    first = y.peek()
    out = None if first is None else y.node(first[0])
    rest = y.peek()
    if not isinstance(out, dict) or rest and rest[1] != "...":
        raise Malformed("no mapping")
    return out


def plain(x: object) -> str:
    """A scalar's text; numbers without a needless fraction."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else ("-" if x < 0 else "") + "Infinity" if math.isinf(x) else str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)
    return str(x)


def kind(x: object) -> str:
    return "null" if x is None else "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "json"


def flat(mapping: dict, prefix: str = "") -> Iterator[tuple[str, str, int, str | None, str]]:
    """(name, card, ord, value, kind) of a mapping: nested names are dotted, lists of scalars give a row an element,
    other lists one row of JSON, empty mappings and lists none."""
    for k, v in mapping.items():
        name = prefix + k
        if isinstance(v, dict):
            yield from flat(v, name + ".")
        elif isinstance(v, list) and any(isinstance(x, (dict, list)) for x in v):
            yield name, "list", 0, json.dumps(v, ensure_ascii=False, separators=(",", ":")), "json"
        else:
            for i, x in enumerate(v if isinstance(v, list) else [v]):
                yield name, "list" if isinstance(v, list) else "scalar", i, None if x is None else plain(x), kind(x)


def rows_of(text: str | None, form: str) -> list[tuple]:
    """The rows of a text in a form, yaml or json; none where it is no mapping."""
    try:
        found = read_yaml(text or "") if form == "yaml" else json.loads(text or "", parse_constant=lambda c: (_ for _ in ()).throw(Malformed(c)))
        return list(flat(found)) if isinstance(found, dict) else []
    except (Malformed, ValueError, RecursionError):
        return []


ROWS = "name string, card string, ord int, value string, kind string"


def properties(docs: DataFrame, key: str, text: str, form: str | None = None) -> DataFrame:
    """(key, name, card, ord, value, kind) of each document's mapping. form: yaml or json for all, or None to read a
    column `format`. Null texts and other formats have no rows."""
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(ROWS).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [(k, *r) for k, t, f in zip(p[key], p["_text"], p["_form"]) for r in rows_of(t, f)]
            yield pd.DataFrame(found, columns=schema.fieldNames(), dtype=object)

    forms = F.lit(form) if form else F.col("format")
    rows = docs.select(key, F.col(text).alias("_text"), forms.alias("_form")).where("_text is not null and _form in ('yaml', 'json')")
    return rows.mapInPandas(run, schema)
