"""Line dedup by range-partitioned hashes and per-document keep bitmaps.

Each line's key (stripped, A-Z lower-cased) becomes a 128-bit xxh3 hash, which stands for the key in all that follows;
a text's lines with one key travel as one row (hash, document, line numbers). Rows are range-partitioned by hash and sorted by hash and document, largest document
first, so one streaming pass sees the keeper first, then knows with the third document that the key is dropped
elsewhere; it holds one waiting row, whatever the group's size. What returns is no text but, for each document, its
dropped lines as a compressed bitmap (zlib), which the documents, read again, apply.

Before the shuffle each batch settles what it can: with min_docs of its own documents in a group all but the largest
lose the key for certain, so of a hot key no more than min_docs - 1 rows leave a batch, flagged with what was seen.

A document is its doc_id: rows that share it, with whatever texts, count once, and all of them keep a line that its
document keeps; bitmaps go back to rows by (doc_id, hash of the text), so each row has the result of its own text. Null
text: one empty line, kept. Null id: counts as one document below all others; its id stays null. Keys shorter than min_chars
stay. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .spark_util import partitions

BATCH_BYTES = 4 << 20
_NEWLINE = 10


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of all lines, and for each document the index of its first line (one more at the end)."""
    nl = np.flatnonzero(data == _NEWLINE)
    before = np.searchsorted(nl, offsets)
    counts = np.diff(before) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[first[:-1]] = offsets[:-1]
    ends[first[1:] - 1] = offsets[1:]
    at = np.arange(len(nl)) + np.searchsorted(offsets[1:], nl, "right")  # line that each newline ends
    ends[at] = nl
    starts[at + 1] = nl + 1
    return starts, ends, first


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ink = np.flatnonzero(~T.IS_SPACE[data])
    if not len(ink):
        return starts, starts
    a, b = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    some = b > a
    s = np.where(some, ink[np.minimum(a, len(ink) - 1)], starts)
    return s, np.where(some, ink[np.maximum(b - 1, 0)] + 1, s)


def text_hash(s: T.Slice) -> np.ndarray:
    return T.text_hashes(s.data, s.offsets)


def keyed(s: T.Slice, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a long enough key: both halves of its hash, document, line number in it."""
    starts, ends, first = lines(s.data, s.offsets)
    a, b = stripped(s.data, starts, ends)
    chars = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
    keep = np.flatnonzero(chars[b] - chars[a] >= min_chars)
    low = memoryview(T.LOWER[s.data])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    digests = b"".join([xxhash.xxh3_128_digest(low[i:j]) for i, j in zip(a[keep].tolist(), b[keep].tolist())])
    h1, h2 = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2).T
    return h1, h2, doc[keep], (keep - first[doc[keep]])


def bitmap(numbers: np.ndarray) -> bytes:
    """The set of line numbers as a compressed bitmap."""
    bits = np.zeros(int(numbers.max()) + 1, np.uint8)
    bits[numbers] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def numbers_of(blob: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8), bitorder="little"))


ROW = "h1 long, h2 long, doc long, th long, docs int, numbers binary"
DROP = "doc long, th long, numbers binary"


def _rows(min_docs: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", BATCH_BYTES):
            th = T.signed(text_hash(s))
            h1, h2, doc, line = keyed(s, min_chars)
            if not len(h1):
                continue
            # Texts by (id, hash), largest first; equal rows are one text.
            rank = np.lexsort((th, s.ids))[::-1]
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            same = np.zeros(len(rank), bool)
            same[1:] = (s.ids[rank][1:] == s.ids[rank][:-1]) & (th[rank][1:] == th[rank][:-1])
            group = (np.cumsum(~same) - 1)[place]
            order = np.lexsort((line, group[doc], h2, h1))
            h1, h2, doc, line = h1[order], h2[order], doc[order], line[order]
            begin = T.distinct_runs(h1, h2, group[doc])
            d = doc[begin]
            new = T.distinct_runs(h1[begin], h2[begin])
            size = np.diff(np.append(new, len(begin)))
            ids = s.ids[d]
            fresh = np.ones(len(begin), bool)  # another document than the row before, or another key
            fresh[1:] = ids[1:] != ids[:-1]
            fresh[new] = True
            many = np.repeat(np.add.reduceat(fresh.astype(np.int64), new), size) >= min_docs
            top = ids == np.repeat(ids[new], size)
            end = np.append(begin[1:], len(h1))
            blobs = [np.unique(line[i:j]).astype("<u4").tobytes() for i, j in zip(begin.tolist(), end.tolist())]
            # docs: documents that the row stands for, itself included; -1: dropped for certain.
            docs = np.where(many, np.where(top, min_docs, -1), 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(h1[begin])), pa.array(T.signed(h2[begin])), pa.array(ids), pa.array(th[d]), pa.array(docs), pa.array(blobs, pa.binary())], ["h1", "h2", "doc", "th", "docs", "numbers"])

    return run


def _stream(min_docs: int):
    """Sorted by key, then document descending; a key's largest document keeps it, later ones are emitted once
    min_docs documents are known to hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keeper, seen, last = None, None, 0, None
        waiting: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for h1, h2, doc, th, docs, numbers in zip(*(b.column(i).to_pylist() for i in range(6))):
                if (h1, h2) != key:
                    key, keeper, seen, last, waiting = (h1, h2), doc, 0, None, []
                if doc != last:
                    seen += docs
                    last = doc
                else:  # another text of the document, or a repeated row of another batch
                    seen = max(seen, docs)
                if doc != keeper:
                    waiting.append((doc, th, numbers))
                if seen >= min_docs and waiting:
                    out += waiting
                    waiting = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["doc", "th", "numbers"])

    return run


def dropped_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, th (hash of the text) and the compressed bitmap of dropped lines, for each document that loses some."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_rows(min_docs, min_chars), ROW)
    settled = rows.where("docs < 0").select("doc", "th", "numbers")
    open_rows = rows.where("docs > 0").repartitionByRange(partitions(spark), "h1", "h2").sortWithinPartitions("h1", "h2", F.col("doc").desc(), F.col("th").desc())
    found = settled.unionByName(open_rows.mapInArrow(_stream(min_docs), DROP))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            out = []
            for doc, th, numbers in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (doc, th) != key:
                    if held:
                        out.append((*key, bitmap(np.frombuffer(b"".join(held), "<u4"))))
                    key, held = (doc, th), []
                held.append(numbers)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["doc", "th", "keep"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([bitmap(np.frombuffer(b"".join(held), "<u4"))])], ["doc", "th", "keep"])

    return found.repartition(partitions(spark), "doc").sortWithinPartitions("doc", "th").mapInArrow(merge, "doc long, th long, keep binary")


def with_dropped(docs: DataFrame, dropped: DataFrame, schema: str, make, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Joins documents with their bitmaps and maps make(slice, i, dropped numbers or None) over the rows."""
    names = [f.split()[0] for f in schema.split(", ")]

    def th(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "__id", "__text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([*s.batch.columns, pa.array(s.ids), pa.array(T.signed(text_hash(s)))], [*s.batch.schema.names, "__doc", "__th"])

    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *extra)
    hashed = base.mapInArrow(th, base.withColumns({"__doc": F.lit(0).cast("long"), "__th": F.lit(0).cast("long")}).schema)
    joined = hashed.join(dropped.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("keep").alias("__keep")), ["__doc", "__th"], "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "__id", "__text", BATCH_BYTES):
            keep = s.batch.column("__keep").to_pylist()
            cols = list(zip(*(make(s, i, None if keep[i] is None else numbers_of(keep[i])) for i in range(len(s.ids)))))
            arrays = [s.batch.column("__id"), *(s.batch.column(c) for c in extra), *(pa.array(c) for c in cols)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(apply, schema)


def kept_text(s: T.Slice, i: int, drop: np.ndarray | None) -> tuple[bytes, int]:
    text = s.text(i)
    n = text.count(b"\n") + 1
    if drop is None:
        return text, n
    gone = set(drop.tolist())
    return b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in gone), n


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""

    def digest(s: T.Slice, i: int, drop: np.ndarray | None) -> tuple[int, int, str]:
        text, n = kept_text(s, i, drop)
        return n, 0 if drop is None else len(drop), hashlib.sha256(text).hexdigest()

    return with_dropped(docs, dropped_lines(docs, min_docs, min_chars), "doc_id long, n_lines long, n_dropped long, kept_sha256 string", digest)
