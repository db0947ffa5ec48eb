"""A training-text pipeline over documents: toxicity, line dedup, n-gram Jaccard join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import filters
from quillon.llm import toxicity as tox
from quillon.llm.packing import pack
from quillon.llm.queries import WORD_BPE
from quillon.llm.spark_util import bound_batches, table, written

#: Of an Arrow batch of documents: below the slices that line_dedup works on, so that a batch is one slice.
BATCH = 15 << 18


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 stay; learns from the labels outside the held-out fold."""
    usable = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return filters.without_toxic(docs, tox.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), usable), 0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 code points that at least 3 documents hold stay in the largest doc_id alone."""
    return filters.with_lines_deduplicated(docs, 3, 20)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 of five-word shingles the least doc_id stays."""
    return filters.without_near_copies(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item at a similarity of 0.8 go."""
    return filters.without_benchmark(docs, table(spark, sf_dir, "benchmark"), 5, 0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path(WORD_BPE), 2048, 1)


def _bounded(stage):
    """The stage with bounded Arrow batches, also when its rows are written after it returns."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark, BATCH)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _bounded(f)) for f in (toxicity, line_dedup, ngram_join, decontamination, packing)]

#: Learnt scores and tokenizers are beyond SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
