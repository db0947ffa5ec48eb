"""Ranks over whole tables without one task holding all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds a 1-based rank by `order`, which must tell all rows apart.

    Rows are range-partitioned and numbered within their partition; the partitions' sizes, one row each, are summed up
    and joined back. Nothing but these counts meets in one task. An empty table keeps its columns and gains the rank.
    """
    part, local = f"{name}__part", f"{name}__local"
    rows = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).persist()
    w = Window.partitionBy(part).orderBy(*order)
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(part, before.alias("before"))
    out = rows.withColumn(local, F.row_number().over(w)).join(F.broadcast(sizes), part)
    return out.withColumn(name, F.col("before") + F.col(local)).drop(part, local, "before")


def top_k(df: DataFrame, order: list[Column], k: int, name: str) -> DataFrame:
    """The first k rows with their rank: a bounded top-k, then a window over these k rows."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))
