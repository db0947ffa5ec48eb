"""Operators as corpus filters: each takes documents with any columns and returns those that stay, same columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate as dec
from . import textops as T
from . import toxicity as tox
from .line_dedup import dropped_lines, kept_text, with_dropped
from .ngram_join import ngram_components


def _kept(docs: DataFrame, keep, id_col: str, text_col: str) -> DataFrame:
    """Rows for whose slices keep() is true; other columns pass through untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, id_col, text_col, 2 << 20, lower=True):
            mask = keep(s)
            yield s.batch if mask.all() else s.batch.filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)


def without_toxic(docs: DataFrame, model: tox.Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops documents with a toxicity score of at least threshold."""

    def keep(s: T.Slice) -> np.ndarray:
        return np.array([tox.probability(model, segs, n) < threshold for _, n, segs in tox.evidence(s, model.words, model.weights, model.drift)], bool)

    return _kept(docs, keep, id_col, text_col)


def with_lines_deduplicated(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Texts without their repeated lines (see line_dedup); chars_col, if there is one, is counted anew. No row goes; a
    text that loses nothing, null included, stays as it is."""
    others = [c for c in docs.columns if c not in (text_col, chars_col)]
    number = docs.select(*others, F.col(text_col).alias("__text")).toDF(*[f"c{i}" for i in range(len(others))], "__text")
    names = {c: f"c{i}" for i, c in enumerate(others)}
    key = names[id_col]
    kinds = {f.name: f.dataType.simpleString() for f in number.schema}
    schema = ", ".join(["__id long", *(f"{names[c]} {kinds[names[c]]}" for c in others), "kept string"])

    def make(s: T.Slice, i: int, drop: np.ndarray | None) -> tuple[str | None]:
        if drop is None:
            return (s.batch.column("__text")[i].as_py(),)
        return (kept_text(s, i, drop)[0].decode(),)

    rows = with_dropped(number, dropped_lines(number, min_docs, min_chars, key, "__text"), schema, make, key, "__text", tuple(names[c] for c in others))
    out = {c: F.col(names[c]) for c in others} | {text_col: F.col("kept")}
    if chars_col in docs.columns:
        out[chars_col] = F.char_length("kept").cast(docs.schema[chars_col].dataType)
    return rows.select(*(out[c].alias(c) for c in docs.columns))


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of linked documents the one with the least id stays; rows without id or shingles stay."""
    found = ngram_components(docs, k, percent, id_col, text_col)
    gone = found.where("component_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def without_benchmark(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops documents that hold a benchmark item."""
    for index in dec.indexes(items, k, threshold):

        def keep(s: T.Slice, index: dec.Index = index) -> np.ndarray:
            mask = np.ones(len(s.ids), bool)
            mask[[row[0] for row in dec.matches(s, index)]] = False
            return mask

        docs = _kept(docs, keep, id_col, text_col)
    return docs
