"""Session helpers of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is made only where none is set and Spark runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Makes Spark drop an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df (with a folder for each value of column by) as a table in the shared folder: cuts lineage, survives lost executors, and is computed once. The shuffles
    behind it are not needed again and go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame, part: str = "") -> None:
    """Deletes a written table, or a folder of it, that nothing reads any more."""
    spark = table.sparkSession
    for root in {f.rsplit("/", 2 if part else 1)[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{part}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes after which Spark ends an Arrow batch; unset, a batch has 10,000 rows of whatever size, and both the JVM and the
#: Python worker hold it several times over.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: int) -> None:
    """From now on the session's Arrow batches end at about size bytes, unless a limit is set already."""
    if not spark.conf.get(_BATCH, None):
        spark.conf.set(_BATCH, str(size))


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """For what runs inside, Arrow batches end at about size bytes."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)
