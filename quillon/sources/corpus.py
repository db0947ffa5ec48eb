"""A text corpus as tables: blocks of Markdown, and sections, tasks, links, properties, outlines derived from them.

Only the block parser is Python, one document at a time and without a shuffle; the rest are DataFrame expressions.
Blocks hold character offsets, so a document's text is its blocks' raw text and the gaps between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import mapping

BLOCKS = "ordinal int, parent int, depth int, type string, text string, raw string, start int, end int, level int, checked boolean, info string, above array<struct<ordinal: int, type: string, text: string>>"

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])(?:[ \t]+|$)(?:\[([ xX])\][ \t]+)?(.*)$")
_TABLE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


@dataclass
class Block:
    type: str
    start: int
    end: int
    text: str = ""
    depth: int = 0
    parent: int | None = None
    level: int | None = None
    checked: bool | None = None
    info: str | None = None
    #: Ordinals of the blocks that hold it, outermost first.
    above: tuple[int, ...] = ()


def parse_blocks(text: str) -> list[Block]:
    """Blocks of a Markdown text in source order; list items nest by indent, all else is flat."""
    out: list[Block] = []
    items: list[tuple[int, int]] = []  # indent and ordinal of the open list items
    lines, at = text.splitlines(keepends=True), 0
    starts = [0]
    for ln in lines:
        starts.append(starts[-1] + len(ln))
    bare = [ln.rstrip("\r\n") for ln in lines]

    def add(kind: str, first: int, last: int, **more) -> Block:
        b = Block(kind, starts[first], starts[last] - (len(lines[last - 1]) - len(bare[last - 1])), **more)
        out.append(b)
        return b

    if bare and bare[0] == "---" and "---" in bare[1:]:
        at = bare.index("---", 1) + 1
        add("frontmatter", 0, at, text="\n".join(bare[1 : at - 1]))
    while at < len(bare):
        line, first = bare[at], at
        if not line.strip():
            at += 1
        elif m := _FENCE.match(line):
            at += 1
            while at < len(bare) and not re.match(rf" {{0,3}}{m[1][0]}{{{len(m[1])},}}[ \t]*$", bare[at]):
                at += 1
            body = bare[first + 1 : at]
            at = min(at + 1, len(bare))
            items.clear()
            add("code", first, at, text="\n".join(body), info=m[2].strip() or None)
        elif m := _HEADING.match(line):
            at += 1
            items.clear()
            add("heading", first, at, text=(m[2] or "").strip(), level=len(m[1]))
        elif _RULE.match(line):
            at += 1
            items.clear()
            add("thematic_break", first, at)
        elif (m := _ITEM.match(line)) and (m[4] or m[2] in "-*+"):
            indent = len(m[1].expandtabs(4))
            while items and items[-1][0] >= indent:
                items.pop()
            at += 1
            body = [m[4]]
            while at < len(bare) and bare[at].strip() and not _starts(bare[at]):
                body.append(bare[at].strip())
                at += 1
            add("task" if m[3] else "list_item", first, at, text="\n".join(body), depth=len(items), parent=items[-1][1] if items else None, checked=m[3] in "xX" if m[3] else None, above=tuple(i for _, i in items))
            items.append((indent, len(out) - 1))
        elif line.lstrip().startswith(">"):
            while at < len(bare) and bare[at].lstrip().startswith(">"):
                at += 1
            items.clear()
            add("blockquote", first, at, text="\n".join(re.sub(r"^ {0,3}> ?", "", x) for x in bare[first:at]))
        elif "|" in line and at + 1 < len(bare) and "|" in bare[at + 1] and _TABLE.match(bare[at + 1]):
            while at < len(bare) and "|" in bare[at]:
                at += 1
            items.clear()
            add("table", first, at, text="\n".join(bare[first:at]))
        else:
            level = None
            at += 1
            while at < len(bare) and bare[at].strip() and not _starts(bare[at]):
                if m := re.match(r" {0,3}(=+|-+)[ \t]*$", bare[at]):
                    level = 1 if m[1][0] == "=" else 2
                    at += 1
                    break
                at += 1
            else:
                if at < len(bare) and re.match(r" {0,3}-{2,}[ \t]*$", bare[at]):
                    level, at = 2, at + 1
            items.clear()
            body = bare[first : at - 1] if level else bare[first:at]
            add("heading" if level else "paragraph", first, at, text="\n".join(x.strip() for x in body), level=level)
    return out


def _starts(line: str) -> bool:
    """A line that ends the paragraph before it."""
    return bool(_HEADING.match(line) or _FENCE.match(line) or _RULE.match(line) or _ITEM.match(line) or line.lstrip().startswith(">"))


#: Bytes at which an Arrow batch of texts ends unless the session has a limit; unset, it has 10,000 texts of whatever size.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000
#: Blocks after which a task hands on what it has parsed.
CHUNK = 4_000


def _parsed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The blocks of batches of (key, text)."""
    for batch in batches:
        at, rows = [], []
        for n in range(batch.num_rows):
            t = batch.column(1)[n].as_py()
            found = parse_blocks(t)
            for i, b in enumerate(found):
                above = [{"ordinal": o, "type": found[o].type, "text": found[o].text} for o in b.above]
                at.append(n)
                rows.append((i, b.parent, b.depth, b.type, b.text, t[b.start : b.end], b.start, b.end, b.level, b.checked, b.info, above))
            if rows and (len(rows) >= CHUNK or n + 1 == batch.num_rows):
                values = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *values], schema=schema)
                at, rows = [], []


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, parent, depth, type, text, raw, start, end, level, checked, info, above); null texts have no block.
    Blocks leave Python by CHUNK, so a task holds a batch of texts and the blocks of a few documents, however many it has."""
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(BLOCKS).fields])
    if not docs.sparkSession.conf.get(_BATCH, None):
        docs.sparkSession.conf.set(_BATCH, str(_BATCH_BYTES))
    arrow = to_arrow_schema(schema)
    return docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).mapInArrow(lambda batches: _parsed(batches, arrow), schema)


def sections(blocks: DataFrame, key: str) -> DataFrame:
    """(key, heading, level, first, last): each heading with the ordinals it covers, up to the next heading that is not
    deeper. One window a level; headings are few."""
    heads = blocks.where(F.col("type") == "heading").select(key, F.col("ordinal").alias("first"), F.col("text").alias("heading"), "level")
    size = blocks.groupBy(key).agg(F.max("ordinal").alias("_last"))
    after = Window.partitionBy(key).orderBy("first").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= n, F.col("first"))).over(after) for n in range(1, 7)]
    for n, e in enumerate(ends, 1):
        heads = heads.withColumn(f"_e{n}", e)
    end = F.coalesce(*(F.when(F.col("level") == n, F.col(f"_e{n}")) for n in range(1, 7)))
    return heads.withColumn("_end", end).join(size, key).select(key, "heading", "level", "first", F.coalesce(F.col("_end") - 1, "_last").alias("last"))


def under_heading(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks in a section whose heading holds a text, case ignored."""
    s = sections(blocks, key).where(F.lower("heading").contains(text.lower())).select(F.col(key).alias("_k"), "first", "last")
    return blocks.join(s, (F.col(key) == F.col("_k")) & F.col("ordinal").between(F.col("first"), F.col("last")), "left_semi")


def tasks(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.where(F.col("type") == "task").select(key, "ordinal", "text", "checked")


#: Link forms: [text](target), [[target|text]], <scheme:...>.
_LINKS = {"md:link": (r"\[[^\]]*\]\(([^)\s]+)[^)]*\)", 1), "md:wikilink": (r"\[\[([^\]|#]+)[^\]]*\]\]", 1), "md:autolink": (r"<([a-z][a-z0-9+.-]*:[^>\s]+)>", 1)}


def links(blocks: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, kind, target), a row per link in source order of each kind; code has none."""

    def of(kind: str) -> Column:
        pattern, group = _LINKS[kind]
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), group), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))

    found = [of(kind) for kind in _LINKS]
    rows = blocks.where(~F.col("type").isin("code", "frontmatter"))
    return rows.select(key, "ordinal", F.explode(F.concat(*found)).alias("l")).select(key, "ordinal", "l.kind", "l.target")


def resolved(links: DataFrame, docs: DataFrame, path: str, doc: str) -> DataFrame:
    """Links with their destination: a document's key by path, or `phantom:` and the target."""
    d = docs.select(F.col(path).alias("target"), F.col(doc).cast("string").alias("_dst"))
    external = F.col("target").rlike("^[a-z][a-z0-9+.-]*:")
    dst = F.when(external, F.col("target")).otherwise(F.coalesce("_dst", F.concat(F.lit("phantom:"), F.col("target"))))
    return links.join(d, "target", "left").withColumn("dst", dst).withColumn("dst_kind", F.when(external, "external").when(F.col("_dst").isNotNull(), "doc").otherwise("phantom")).drop("_dst")


def _samples(rows: DataFrame, by: list[str], value: str, n: int, name: str) -> DataFrame:
    """Counts by some columns, with the n least distinct values of another."""
    w = Window.partitionBy(*by).orderBy(value)
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_n", F.row_number().over(w))
    return counted.groupBy(*by).agg(F.sum("_c").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= n, F.col(value)))).alias(name), F.count(F.lit(1)).alias("of"))


def stale_links(resolved_links: DataFrame, key: str) -> DataFrame:
    """(dst, n, sources, of): destinations that no document answers, with three of the documents that name them."""
    return _samples(resolved_links.where(F.col("dst_kind") == "phantom"), ["dst"], key, 3, "sources")


def edge_counts(links: DataFrame, predicate: str, dst: str, source: str | None = None) -> DataFrame:
    """Rollup of edges: how many per predicate and destination, with three of their sources if there is a column."""
    if source is None:
        return links.groupBy(predicate, dst).agg(F.count(F.lit(1)).alias("n"))
    return _samples(links, [predicate, dst], source, 3, "samples").drop("of")


def adopted(links: DataFrame, docs: DataFrame, path: str, doc: str) -> DataFrame:
    """Links whose phantom destination has become a document lead to it."""
    d = docs.select(F.concat(F.lit("phantom:"), path).alias("dst"), F.col(doc).cast("string").alias("_new"))
    rows = links.join(d, "dst", "left")
    return rows.select(*(F.coalesce("_new", "dst").alias(c) if c == "dst" else F.when(F.col("_new").isNotNull(), "doc").otherwise(F.col(c)).alias(c) if c == "dst_kind" else c for c in links.columns))


def inbound(links: DataFrame, dst: str, ids: DataFrame) -> DataFrame:
    """Links that lead to some documents (one column of ids)."""
    return links.join(ids.select(F.col(ids.columns[0]).alias(dst)).distinct(), dst, "left_semi")


def retargeted(blocks: DataFrame, raw: str, moves: DataFrame) -> DataFrame:
    """Blocks with their link destinations rewritten after moves (old, new): (old) in Markdown links, [[old in wikilinks.
    Only blocks that name an old path change; moves must not chain."""
    targets = F.regexp_extract_all(raw, F.lit(r"\]\(/?([^)\s#]+)|\[\[([^\]|#]+)"), F.lit(0))
    at = blocks.withColumn("_row", F.monotonically_increasing_id())
    named = at.select("_row", F.explode(F.array_distinct(targets)).alias("_t")).withColumn("old", F.regexp_replace("_t", r"^(?:\]\(/?|\[\[)", ""))
    pairs = named.join(moves, "old").groupBy("_row").agg(F.collect_list(F.struct("_t", F.concat(F.expr("substring(_t, 1, length(_t) - length(old))"), "new").alias("new"))).alias("_m"))
    rows = at.join(pairs, "_row", "left")
    text = F.when(F.col("_m").isNull(), F.col(raw)).otherwise(F.aggregate("_m", F.col(raw), lambda s, m: F.replace(s, m["_t"], m["new"])))
    return rows.withColumn(raw, text).select(*blocks.columns)


def tree(docs: DataFrame, path: str) -> DataFrame:
    """(directory, n): how many documents each directory holds, with those below it; the root is the empty one."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return docs.select(F.explode(above).alias("directory")).groupBy("directory").agg(F.count(F.lit(1)).alias("n"))


def json_entries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, kind, value) of each entry of a document that is a JSON mapping; values are texts, nested ones JSON.
    Malformed documents have none."""
    entries = F.from_json(text, "map<string, string>")
    rows = docs.where(F.col(text).rlike(r"^\s*\{")).select(key, F.explode(F.map_entries(entries)).alias("e")).select(key, F.col("e.key").alias("name"), F.col("e.value").alias("value"))
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^\{"), "object").when(F.col("value").rlike(r"^\["), "array").otherwise(scalar_kind(F.col("value")))
    return rows.withColumn("kind", kind).select(key, "name", "kind", "value")


def scalar_kind(value: Column) -> Column:
    """The kind that a plain YAML scalar has."""
    return (
        F.when(value.isNull() | value.isin("", "~", "null", "Null", "NULL"), "null").when(value.rlike("^(true|True|TRUE|false|False|FALSE)$"), "bool")
        .when(value.rlike(r"^[-+]?(\d+|\d*\.\d+|\d+\.\d*)([eE][-+]?\d+)?$"), "number").otherwise("string")
    )


#: Inline fields: [name:: value] or (name:: value) in a line, and name:: value as a line, after a list marker or not.
_FIELDS = [r"[\[(]([A-Za-z][A-Za-z0-9_]*)::[ \t]*([^\]\n)]*?)[ \t]*[\])]", r"(?m)^[ \t]*(?:(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?)?([A-Za-z][A-Za-z0-9_]*)::[ \t]*([^\n]*?)[ \t]*$"]


def properties(blocks: DataFrame, key: str) -> DataFrame:
    """(key, source, name, ord, value, kind, card): the front matter's mapping and inline fields outside code. A field that
    a document has several times is a list in the order of its places."""
    front = mapping.properties(blocks.where(F.col("type") == "frontmatter").select(key, "text"), key, "text", "yaml").withColumn("source", F.lit("frontmatter"))
    body = blocks.where(~F.col("type").isin("code", "frontmatter")).select(key, "ordinal", F.regexp_replace("text", r"(`+)[^`]+\1", "").alias("text"))

    def found(form: int) -> Column:
        groups = lambda m: F.struct(F.lit(form).alias("form"), F.regexp_extract(m, _FIELDS[form], 1).alias("name"), F.regexp_extract(m, _FIELDS[form], 2).alias("value"))
        return F.transform(F.regexp_extract_all("text", F.lit(_FIELDS[form]), F.lit(0)), groups)

    fields = body.select(key, "ordinal", F.posexplode(F.concat(found(0), found(1))).alias("p", "m")).select(key, "ordinal", "p", "m.name", F.trim("m.value").alias("value"))
    each = Window.partitionBy(key, "name")
    fields = fields.withColumn("ord", F.row_number().over(each.orderBy("ordinal", "p")) - 1).withColumn("card", F.when(F.count(F.lit(1)).over(each) > 1, "list").otherwise("scalar"))
    number = r"^([-+]?(\d+|\d*\.\d+|\d+\.)([eE][-+]?\d+)?|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$"
    fields = fields.withColumn("kind", F.when(F.col("value").isin("true", "false"), "bool").when(F.col("value").rlike(number), "number").otherwise("string")).withColumn("source", F.lit("inline"))
    out = [key, "source", "name", "ord", "value", "kind", "card"]
    return front.select(*out).unionByName(fields.select(*out))


def computed(blocks: DataFrame, key: str) -> DataFrame:
    """(key, name, ord, value): `_title`, the first top heading with a text, and `_tags`, the #tags outside headings and
    code, each once, in the order in which they first stand."""
    body = blocks.where(~F.col("type").isin("code", "frontmatter"))
    heads = body.where("type = 'heading' and level = 1 and trim(text) <> ''")
    titles = heads.groupBy(key).agg(F.min_by("text", "ordinal").alias("value")).select(key, F.lit("_title").alias("name"), F.lit(0).alias("ord"), "value")
    tags = body.where("type <> 'heading'").select(key, "ordinal", F.posexplode(F.regexp_extract_all("raw", F.lit(r"(?:^|\s)#([a-zA-Z][\w/-]*)"), F.lit(1))).alias("p", "value"))
    tags = tags.groupBy(key, "value").agg(F.min(F.struct("ordinal", "p")).alias("at"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return titles.unionByName(tags.select(key, F.lit("_tags").alias("name"), order.alias("ord"), "value"))


def outline(blocks: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, line): a document's headings, indented by level."""
    heads = blocks.where(F.col("type") == "heading")
    return heads.select(key, "ordinal", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.col("text")).alias("line"))


def rendered(blocks: DataFrame, key: str, gap: str = "\n\n") -> DataFrame:
    """Documents from their blocks' raw texts in order."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "raw")))
    return blocks.groupBy(key).agg(F.array_join(F.transform(parts, lambda b: b["raw"]), gap).alias("text"))


def page(rows: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """A keyset page: rows after a cursor in order."""
    if after is not None:
        mine, theirs = F.struct(*order), F.struct(*(F.lit(x).alias(c) for x, c in zip(after, order)))
        rows = rows.where(mine > theirs)
    return rows.orderBy(*order).limit(limit)


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, href): the anchors of raw pages."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'<a\s+href="([^"]*)"'), 1)).alias("ord", "href"))
