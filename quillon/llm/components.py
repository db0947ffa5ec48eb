"""Connected components of an edge table by alternating large-star and small-star rounds, each written as a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import partitions, written

EDGE = "u long, v long"


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (node, least node of its component) with the components of the edges."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            u, v = contract(np.asarray(b.column(0)), np.asarray(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (u, v) that is not its component's least.

    Null ends and loops don't count. Each round is a group-by with map-side combining and a join; a batch's edges are
    contracted to a forest before they are shuffled, so repeated edges and hot nodes leave a batch once.
    """
    spark = edges.sparkSession
    now = written(edges.where("u is not null and v is not null and u <> v").select("u", "v").mapInArrow(_contracted, EDGE), "forest")
    while True:
        # Large star: every neighbour that is larger than a node links to the node's least neighbour (or itself).
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: a node and its smaller neighbours link to the least of them.
        large = written(large.mapInArrow(_contracted, EDGE), "large")
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = written(small, "small")
        # A star forest: every node has one parent, and no parent has one.
        parents = now.groupBy(F.col("u").alias("p")).agg(F.count(F.lit(1)).alias("n"))
        if now.join(parents, F.col("v") == F.col("p"), "left_semi").isEmpty() and parents.where("n > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
