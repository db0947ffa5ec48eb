"""Bounded walks over an edge table: every path from each seed, cycles cut where they close.

A walk is a step per depth, each a join of the narrow frontier (key and path) with the edges; rows' other columns are
joined to the result once. A level is persisted, so it can be computed again when an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked

#: The deepest level of any walk.
MAX_DEPTH = 8


def walk(seeds: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH, distinct: bool = False, ordinal: bool = False, least: int | None = None) -> DataFrame:
    """Occurrences (key, depth, path, stop[, ordinal]) of a walk.

    seeds: key[, frontier]. edges: src, dst[, frontier, depth, rank]; of several edges from src to dst the least rank
    counts; its depth says how deep a row may be that it leads on from, and least is the lowest of these. A frontier is kept and not expanded. stop: cycle, frontier, depth, leaf or interior. distinct keeps each
    key's least (depth, path). Null keys are keys like others; an empty seed table gives an empty result.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")
    false = F.lit(False)
    for name, default in (("frontier", false), ("depth", F.lit(depth)), ("rank", F.lit(0))):
        if name not in edges.columns:
            edges = edges.withColumn(name, default)
    edges = edges.select("src", F.struct("rank", "dst", "frontier", F.col("depth").alias("upto")).alias("e"))
    edges = edges.groupBy("src", F.col("e.dst").alias("dst")).agg(F.min("e").alias("e")).select("src", "dst", F.col("e.frontier").alias("marked"), F.col("e.upto").alias("upto"))
    least = depth if least is None else least
    edges = edges.persist()
    level = seeds.select("key", F.array("key").alias("path"), (F.coalesce("frontier", false) if "frontier" in seeds.columns else false).alias("marked"), false.alias("cycle"))
    levels = []
    for d in range(1, depth + 1):
        open_ = (~F.col("cycle")) & (~F.col("marked"))
        steps = edges.where(F.col("upto") > d)
        have = steps.select(F.col("src").alias("s"), F.lit(True).alias("found")).distinct()
        rows = level.join(have, level["key"].eqNullSafe(have["s"]) & open_, "left")
        more = (F.coalesce("found", false) if d < depth else false) & open_
        stop = F.when(F.col("cycle"), "cycle").when(F.col("marked"), "frontier").when(more, "interior").when(F.lit(d >= least), "depth").otherwise("leaf")
        rows = rows.select("key", F.lit(d).alias("depth"), "path", stop.alias("stop")).persist()
        levels.append(rows)
        grown = rows.where(F.col("stop") == "interior")
        if d == depth or grown.isEmpty():
            break
        level = grown.join(steps, F.col("key").eqNullSafe(F.col("src"))).select(F.col("dst").alias("key"), F.concat("path", F.array("dst")).alias("path"), "marked", F.exists("path", lambda x: x.eqNullSafe(F.col("dst"))).alias("cycle"))
    out = levels[0]
    for rows in levels[1:]:
        out = out.unionByName(rows)
    if ordinal:
        out = ranked(out, [F.col("depth"), F.col("path")], "ordinal")
    if distinct:
        first = Window.partitionBy("key").orderBy("depth", "path")
        out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out


def neighbourhood(links: DataFrame, start: list, degrees: int = 1, direction: str = "both", predicate: str | None = None, max_documents: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, links) within some degrees of start documents: documents with their distance, links among them. With
    max_documents the nearest ones alone, by (distance, key).

    links: src, dst, predicate. start is a literal list of ids, given with the query.
    """
    chosen = links if predicate is None else links.where(F.col("predicate") == predicate)
    out, back = chosen.select("src", "dst"), chosen.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()
    seen = links.sparkSession.createDataFrame([(x,) for x in start], links.select(F.col("src").alias("key")).schema).withColumn("distance", F.lit(0))
    front = seen
    for d in range(1, degrees + 1):
        reached = front.join(edges, F.col("key") == F.col("src")).select(F.col("dst").alias("key")).distinct()
        front = reached.join(seen, "key", "left_anti").withColumn("distance", F.lit(d)).persist()
        seen = seen.unionByName(front)
    if max_documents is not None:
        seen = seen.orderBy("distance", "key").limit(max_documents)
    among = chosen.join(seen.select(F.col("key").alias("src")), "src", "left_semi").join(seen.select(F.col("key").alias("dst")), "dst", "left_semi")
    return seen, among
