"""The change feed and folder observation as streams."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.history import read_at
from ..operators.search import due


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where none is set and Spark runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="feed-")
    return found.rstrip("/")


def tail(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """An append-only Parquet feed as a stream; the query's checkpoint is the consumer's cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Handles what has arrived, batch by batch, and stops. `each` may see a batch again after a failure."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observe(known: DataFrame, batch: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """What a batch of files changes: (path, text, hash, kind); unchanged bytes are dropped. Of several versions of one
    path in a batch the greatest `seq` counts, if the batch has that column."""
    rows = read_at(batch, path, "seq") if "seq" in batch.columns else batch.dropDuplicates([path])
    rows = rows.select(path, text, F.sha2(F.coalesce(text, F.lit("")), 256).alias("hash"))
    old = known.select(F.col(path), F.col("hash").alias("_old"))
    kind = F.when(F.col("_old").isNull(), "create").otherwise("update")
    return rows.join(old, path, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("hash"))).select(path, text, "hash", kind.alias("kind"))


def rescan(known: DataFrame, present: DataFrame, path: str = "path") -> DataFrame:
    """After an expired cursor: (path, kind) of what was created, updated or deleted, from two (path, hash) tables."""
    a, b = known.select(path, F.col("hash").alias("_a")), present.select(path, F.col("hash").alias("_b"))
    kind = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "delete").when(F.col("_a") != F.col("_b"), "update")
    return a.join(b, path, "full").select(path, kind.alias("kind")).where(F.col("kind").isNotNull())


def stale(cache: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Paths of a listing (path, mtime, size) whose stat differs from the cache's or that it lacks: those to hash."""
    return listing.join(cache.select(path, "mtime", "size"), [path, "mtime", "size"], "left_anti")


def recoverable(deleted: DataFrame, now: str, ttl_days: int = 30) -> DataFrame:
    """Deleted rows (with `deleted_at`) that may still come back."""
    return deleted.where(F.col("deleted_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(ttl_days)))


def append(folder: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes each batch to its own subfolder, so that a repeated batch replaces itself."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")


def backlog_alerts(pending: DataFrame, repo: str, created: str, now: str, minutes: int = 15) -> DataFrame:
    """(repo, code, severity, pending, oldest): one alert for each repository with pending rows older than a threshold."""
    late = pending.where(F.col(created) < F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))
    return late.groupBy(repo).agg(F.lit("materialization_backlog").alias("code"), F.lit("warning").alias("severity"), F.count(F.lit(1)).alias("pending"), F.min(created).alias("oldest"))


def updated_alerts(known: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """The alert table (repo, code, severity, pending, oldest, since, cleared_at) after a check: alerts that hold keep
    their `since`, new and returning ones begin now, those no longer found are cleared now."""
    k = known.select("repo", "code", F.col("severity").alias("_s"), F.col("pending").alias("_p"), F.col("oldest").alias("_o"), F.col("since").alias("_since"), F.col("cleared_at").alias("_cleared"))
    at, held = F.lit(now).cast("timestamp"), F.col("_since").isNotNull() & F.col("_cleared").isNull()
    on = F.col("severity").isNotNull()
    rows = found.join(k, ["repo", "code"], "full")
    return rows.select("repo", "code", F.coalesce("severity", "_s").alias("severity"), F.when(on, F.col("pending")).otherwise(F.col("_p")).alias("pending"), F.when(on, F.col("oldest")).otherwise(F.col("_o")).alias("oldest"), F.when(on & ~held, at).otherwise(F.col("_since")).alias("since"), F.when(on, None).otherwise(F.coalesce("_cleared", at)).alias("cleared_at"))


def embedded(tasks: Callable[[DataFrame], DataFrame], folder: str, embed: Callable[[DataFrame], DataFrame], model: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that embeds what a feed batch changed and is not yet in the cache folder; a repeated batch finds
    its own vectors there and adds nothing twice."""

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        out = f"{folder}/batch={n}"
        todo = tasks(batch)
        try:
            cache = spark.read.option("basePath", folder).parquet(folder).where(F.col("batch") != n)
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            todo = due(todo, cache, model)
        embed(todo).withColumn("model", F.lit(model)).write.mode("overwrite").parquet(out)

    return each
