"""WARC fixity audit by Merkle trees.

A page becomes a WARC response record; files hold FANOUT consecutive record positions, with each record's offset. The
tree's leaves are records (position, length, SHA-256 of the bytes); an inner node hashes its children in order of
position, each with the offset of its bytes in the node, its length and its digest, FANOUT children at most, so the
level-1 nodes are the files. Every level is written once. Two replicas are compared from the root; only children of
mismatching nodes are compared on the next level, down to the records, whose offsets are computed in mismatching files
alone.

All of it is DataFrame expressions: one aggregation per level with map-side combining, levels a 256th of the one below,
and the descent's joins touch mismatching branches only.

Null ids: a position of their own below all others. Records that repeat a position are one leaf that hashes their count,
their least and greatest digest and the sums of all four quarters of the digests, so repeats in any number cost one row;
they are reported with their total length. Null uri or body: empty. Empty replicas: the other's records are missing or
extra. Very long bodies are hashed whole. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import written

#: Children of a node, and records of a file.
FANOUT_BITS = 8


def record(uri: Column, body: Column) -> Column:
    """The record's text: WARC/1.1 header with the body's length in bytes, body, and two line ends."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")
    )


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """position, length and sha256 of each record."""
    text = record(F.col(uri_col), F.col(body_col))
    return pages.select(F.col(id_col).cast("long").alias("position"), F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("sha256"))


def leaves(recs: DataFrame) -> DataFrame:
    """One leaf per position: its records' count, total length, and one digest."""
    quarters = [F.sum(F.conv(F.substring("sha256", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).alias(f"q{i}") for i in range(4)]
    g = recs.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.min("sha256").alias("low"), F.max("sha256").alias("high"), *quarters)
    one = F.when(F.col("n") == 1, F.col("low")).otherwise(F.sha2(F.concat_ws("|", "n", "low", "high", "q0", "q1", "q2", "q3"), 256))
    return g.select("position", F.coalesce("position", F.lit(-(2**63))).alias("node"), "n", "length", one.alias("sha256"))


def parents(level: DataFrame) -> DataFrame:
    """The next level: nodes over FANOUT positions of the one below, each with its bytes and records."""
    children = F.array_sort(F.collect_list(F.struct("node", "length", "sha256")))
    start = F.struct(F.lit(0).cast("long").alias("offset"), F.lit("").alias("text"))
    text = lambda s, c: F.concat_ws(":", s["text"], c["node"], s["offset"], c["length"], c["sha256"])
    text = F.aggregate(children, start, lambda s, c: F.struct((s["offset"] + c["length"]).alias("offset"), text(s, c).alias("text")), lambda s: s["text"])
    up = F.shiftrightunsigned("node", FANOUT_BITS)
    return level.groupBy(up.alias("parent")).agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.sha2(text, 256).alias("sha256")).withColumnRenamed("parent", "node")


def offsets(leaf: DataFrame) -> DataFrame:
    """Offset of each leaf's bytes in its file."""
    file = F.shiftrightunsigned("node", FANOUT_BITS)
    before = Window.partitionBy("warc_file").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("warc_file", file).withColumn("record_offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _in(level: DataFrame, suspects: DataFrame) -> DataFrame:
    """The children of suspect nodes."""
    return level.withColumn("up", F.shiftrightunsigned("node", FANOUT_BITS)).join(suspects, "up", "left_semi").drop("up")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records (see records()) that differ: page_id, fault ('changed', 'missing' in right, 'extra' in right), warc_file,
    record_offset (in left), lengths and digests on both sides."""
    a, b = written(leaves(left), "leaves"), written(leaves(right), "leaves")
    bounds = a.select("node").unionByName(b.select("node")).agg(F.min("node"), F.max("node")).first()
    depth = 0
    if bounds[0] is not None:
        lo, hi = (x & (1 << 64) - 1 for x in bounds)
        while lo >> FANOUT_BITS * depth != hi >> FANOUT_BITS * depth or (depth == 0):
            depth += 1
    levels = [(a, b)]
    for _ in range(depth):
        levels.append(tuple(written(parents(x), "level") for x in levels[-1]))
    suspects = None
    for la, lb in reversed(levels):
        if suspects is not None:
            la, lb = _in(la, suspects), _in(lb, suspects)
        if "position" in la.columns:  # the leaves: only those of mismatching files
            la = offsets(la)
        else:
            la, lb = (x.withColumn("position", F.lit(None).cast("long")) for x in (la, lb))
            la = la.withColumn("record_offset", F.lit(None).cast("long"))
        x = la.select("node", "position", "record_offset", F.col("length").alias("length_a"), F.col("sha256").alias("sha_a"))
        y = lb.select("node", F.col("position").alias("position_b"), F.col("length").alias("length_b"), F.col("sha256").alias("sha_b"))
        differ = x.join(y, "node", "full_outer").where(~F.col("sha_a").eqNullSafe(F.col("sha_b")))
        suspects = differ.select(F.col("node").alias("up"))
    fault = F.when(F.col("sha_b").isNull(), "missing").when(F.col("sha_a").isNull(), "extra").otherwise("changed")
    return differ.select(F.coalesce("position", "position_b").alias("page_id"), fault.alias("fault"), F.shiftrightunsigned("node", FANOUT_BITS).alias("warc_file"), "record_offset", "length_a", "length_b", "sha_a", "sha_b")
