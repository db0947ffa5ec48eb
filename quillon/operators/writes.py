"""Writes above the structural edits: macros, plans with their digest, writes that a query directs, whole-document updates.

All give edits as rows (doc, seq, op, id, raw, after, expect) for `edits.apply_edits`; `expect` holds the text that a block
has now, so an edit of a block that changed meanwhile fails and changes nothing. Blocks: doc, id, order, raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import match_blocks


def _edits(rows: DataFrame, op: str, id_: Column | None = None, raw: Column | None = None, after: Column | None = None, expect: Column | None = None, order: str = "order") -> DataFrame:
    """One edit a row, numbered by document in order."""
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else c
    seq = F.row_number().over(Window.partitionBy("doc").orderBy(order, "id"))
    return rows.select("doc", seq.cast("long").alias("seq"), F.lit(op).alias("op"), pick(id_).alias("_i"), pick(raw).alias("_r"), pick(after).alias("after"), pick(expect).alias("expect")).withColumnsRenamed({"_i": "id", "_r": "raw"})


def complete_tasks(tasks: DataFrame) -> DataFrame:
    """Ticks the box of each block."""
    return _edits(tasks, "update", F.col("id"), F.regexp_replace("raw", r"^(\s*(?:[-*+]|\d+[.)])\s+)\[[ xX]\]", "$1[x]"), expect=F.col("raw"))


def rename_sections(headings: DataFrame, title: Column) -> DataFrame:
    """Gives headings another title at their level."""
    marks = F.regexp_extract("raw", r"^\s*(#+)", 1)
    return _edits(headings, "update", F.col("id"), F.concat(F.when(marks == "", "#").otherwise(marks), F.lit(" "), title), expect=F.col("raw"))


def append_to_documents(blocks: DataFrame, docs: DataFrame, raw: Column) -> DataFrame:
    """A block at the end of each of some documents (doc); empty documents get it as their first."""
    last = blocks.groupBy("doc").agg(F.max_by("id", "order").alias("_last"))
    rows = docs.join(last, "doc", "left").withColumn("order", F.lit(0)).withColumn("id", F.lit(""))
    return _edits(rows, "insert", raw=raw, after=F.col("_last"))


def append_to_sections(sections: DataFrame, blocks: DataFrame, raw: Column) -> DataFrame:
    """A block at the end of each section (doc, first, last: the orders that it covers)."""
    ends = sections.join(blocks.select("doc", F.col("order").alias("last"), F.col("id").alias("_end")), ["doc", "last"])
    return _edits(ends.withColumn("order", F.col("last")).withColumn("id", F.col("_end")), "insert", raw=raw, after=F.col("_end"))


def move_sections(sections: DataFrame, blocks: DataFrame, after: Column) -> DataFrame:
    """Moves all blocks of a section (doc, first, last, and what `after` reads: an id behind which it goes, null for the
    front), one behind the other."""
    rows = blocks.join(sections.withColumn("_to", after), "doc").where(F.col("order").between(F.col("first"), F.col("last")))
    before = F.lag("id").over(Window.partitionBy("doc", "first").orderBy("order"))
    return _edits(rows.withColumn("_before", before), "move", F.col("id"), after=F.coalesce("_before", "_to"), expect=F.col("raw"))


def insert_list_items(anchors: DataFrame, text: Column) -> DataFrame:
    """A list item behind each anchor (doc, id, order)."""
    return _edits(anchors, "insert", raw=F.when(F.trim(text).startswith("- "), text).otherwise(F.concat(F.lit("- "), text)), after=F.col("id"))


def directed(hits: DataFrame, op: str, raw: Column | None = None, at_most: int | None = None) -> DataFrame:
    """A query's hits (doc, id, order, raw) as edits of one kind. More hits than at_most are an error and write nothing."""
    if at_most is not None:
        n = F.count(F.lit(1)).alias("_n")
        limit = hits.limit(at_most + 1).agg(n).select(F.when(F.col("_n") > at_most, F.raise_error(F.lit(f"more than {at_most} hits"))).cast("string").alias("_ok"))
        hits = hits.crossJoin(F.broadcast(limit)).where("_ok is null")  # limit is one row
    return _edits(hits, op, F.col("id"), raw, expect=F.col("raw"))


def plan(edits: DataFrame) -> DataFrame:
    """(edits, documents, digest): what a set of edits will do. The digest is that of all edits in order; who runs the plan
    later compares it first."""
    one = F.sha2(F.to_json(F.struct("doc", "seq", "op", "id", "raw", "after", "expect")), 256)
    by_doc = edits.select("doc", "seq", one.alias("h")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    quarters = [F.sum(F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return by_doc.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edits"), F.count(F.lit(1)).alias("documents"), F.sha2(F.concat_ws("|", *quarters), 256).alias("digest"))


def update_documents(current: DataFrame, proposal: DataFrame) -> DataFrame:
    """Edits that turn documents into a proposal (doc, order, raw): blocks that match keep their ids. Those that are gone
    are removed first; then each block of the proposal, in order, is updated, moved behind the one before, or inserted."""
    new = proposal.select("doc", F.concat(F.lit("n"), F.col("order").cast("string")).alias("id"), F.col("order").alias("ordinal"), F.col("raw").alias("text"))
    old = current.select("doc", "id", F.col("order").alias("ordinal"), F.col("raw").alias("text"))
    found = match_blocks(old, new).where("method <> 'near'")
    gone = found.where("new_id is null").select("doc", F.col("old_id").alias("id")).join(current, ["doc", "id"])
    removed = gone.select("doc", F.lit(0).alias("_at"), F.col("order").alias("_k"), F.lit("remove").alias("op"), "id", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("after"), F.col("raw").alias("expect"))
    kept = new.join(found.where("new_id is not null").select("doc", F.col("new_id").alias("id"), "old_id"), ["doc", "id"]).withColumn("_id", F.coalesce("old_id", F.concat(F.lit("new_"), F.sha2(F.concat_ws("|", "doc", "id"), 256))))
    kept = kept.withColumn("_before", F.lag("_id").over(Window.partitionBy("doc").orderBy("ordinal")))
    now = kept.join(current.select("doc", F.col("id").alias("old_id"), F.col("raw").alias("_raw")), ["doc", "old_id"], "left")
    none = F.lit(None).cast("string")
    placed = now.select("doc", F.lit(1).alias("_at"), (F.col("ordinal") * 2).alias("_k"), F.when(F.col("old_id").isNull(), "insert").otherwise("move").alias("op"), F.col("_id").alias("id"), F.when(F.col("old_id").isNull(), F.col("text")).alias("raw"), F.col("_before").alias("after"), none.alias("expect"))
    changed = now.where(F.col("old_id").isNotNull() & (F.col("_raw") != F.col("text"))).select("doc", F.lit(1).alias("_at"), (F.col("ordinal") * 2 + 1).alias("_k"), F.lit("update").alias("op"), F.col("_id").alias("id"), F.col("text").alias("raw"), none.alias("after"), F.col("_raw").alias("expect"))
    rows = removed.unionByName(placed).unionByName(changed)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("_at", "_k")).cast("long")).select("doc", "seq", "op", "id", "raw", "after", "expect")
