"""Repeated token spans by compacting a De Bruijn graph over word k-mers.

The graph's edges are windows of `window` consecutive words. They are dealt by anchor, the least hash of the ANCHOR-word
k-mers inside a window: edges that follow each other in a document and share their anchor travel as one packed run, a
path, with its source coordinates (document, first window).

1. Path join. Runs meet by anchor, sorted by path and coordinates. Runs of one path are the same chain of edges: the
   occurrence with the least coordinates is the path's source, every other one is a repeated span of it as a whole.
2. Branch join. An anchor with one path is nonbranching, its chain stays compact. Where an anchor has several paths the
   graph branches: the sources of those paths go back to their documents by a join and are cut into single edges, which
   meet by hash; the least coordinates are the source, the others are repeats.
3. Compaction. Repeats that follow each other in a document, and whose sources do so too, are one longer repeat: chains
   join across anchors and branches by their coordinates alone.
4. Verification. Every repeat is compared with its source: the source's document, found by its coordinates, and the
   repeat's own document both digest the words of the range (BLAKE2b, 128 bits); a repeat whose digest differs removes
   nothing. Hashes above only propose.

Each slice of documents settles its own repeats of a path before the shuffle (all but the least coordinates are spans
already, compacted there and sent along a few dozen to a row), so a path that a third of all rows hold sends one row per
slice and every text is cut into paths once; both joins stream over sorted rows and hold one row at a time, whatever the
size of a group.

Coordinates order by (doc_id, hash of the text, position), so rows that repeat both are one document, with one result
each. Null id: below all others, kept null. Null or empty text: no words. Empty table: no rows. Extra columns are not
read. Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .line_dedup import text_hash
from .spark_util import partitions, written

#: Words of an anchor.
ANCHOR = 8
SLICE = 4 << 20


def word_codes(s: T.Slice) -> tuple[T.Words, np.ndarray]:
    w = T.words(s.data, s.offsets)
    return w, T.span_hashes(s.data, w.starts, w.ends)


def window_minimum(x: np.ndarray, k: int) -> np.ndarray:
    """Index of the (first) least of each k consecutive values."""
    n = len(x) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # Doubling: the least of 2**j consecutive values from the least of halves.
    at, span = np.arange(len(x)), 1
    while 2 * span <= k:
        a, b = at[: len(at) - span], at[span:]
        at = np.where(x[b] < x[a], b, a)
        span *= 2
    a, b = at[:n], at[k - span : k - span + n]
    return np.where(x[b] < x[a], b, a)


def paths(codes: np.ndarray, first: np.ndarray, window: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of a slice: first and last window (indices of their first words), anchor hash, path hash."""
    n = len(codes) - window + 1
    if n <= 0:
        z = np.empty(0, np.int64)
        return z, z, z.astype(T.U64), z.astype(T.U64)
    a = T.window_hashes(codes, anchor, 11)
    least = window_minimum(a, window - anchor + 1)
    ok = np.flatnonzero(T.inside(first, window, n))
    if not len(ok):
        z = np.empty(0, np.int64)
        return z, z, z.astype(T.U64), z.astype(T.U64)
    pick = least[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (ok[1:] != ok[:-1] + 1)
    begin = np.flatnonzero(new)
    lo = ok[begin]
    hi = ok[np.append(begin[1:], len(ok)) - 1]
    # Windows of one path share a k-mer, so the first and the last one cover it.
    edge = T.window_hashes(codes, window, 13)
    return lo, hi, a[pick[begin]], T.mix64(edge[lo] + T.mix64(edge[hi] + (hi - lo).astype(T.U64)))


REPEAT, BRANCH = 1, 2
SPAN = "doc long, th long, lo int, n int, sdoc long, sth long, slo int"
#: settled: null for a path, else repeats that a slice has settled itself, packed as SETTLED.
ROW = "anchor long, path long, doc long, th long, lo int, n int, settled binary"
FOUND = "kind int, " + SPAN
SETTLED = np.dtype([("doc", "<i8"), ("th", "<i8"), ("lo", "<i4"), ("n", "<i4"), ("sdoc", "<i8"), ("sth", "<i8"), ("slo", "<i4")])
#: Settled repeats of a row: a batch of 10,000 such rows has 28 MB.
PACK = 64


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.asarray(c), kinds[t]) for c, t in zip(columns, types)], list(names))


def _follows(doc: np.ndarray, th: np.ndarray, lo: np.ndarray, n: np.ndarray, sdoc: np.ndarray, sth: np.ndarray, slo: np.ndarray) -> np.ndarray:
    """Mask of sorted repeats: it continues the one before, and its source that one's source."""
    on = np.zeros(len(doc), bool)
    on[1:] = (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (lo[1:] == lo[:-1] + n[:-1]) & (sdoc[1:] == sdoc[:-1]) & (sth[1:] == sth[:-1]) & (slo[1:] == slo[:-1] + n[:-1])
    return on


def _paths(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", SLICE):
            th = T.signed(text_hash(s))
            w, codes = word_codes(s)
            lo, hi, anchor, path = paths(codes, w.first, window)
            if not len(lo):
                continue
            doc = w.doc[lo]
            start = lo - w.first[doc]
            order = np.lexsort((start, th[doc], s.ids[doc], path, anchor))
            source = np.zeros(len(order), bool)
            source[T.distinct_runs(anchor[order], path[order])] = True
            # A repeated row (same id and text) repeats its coordinates: it is no later occurrence.
            d, p = doc[order], start[order]
            head = np.maximum.accumulate(np.where(source, np.arange(len(order)), 0))
            source |= (s.ids[d] == s.ids[d[head]]) & (th[d] == th[d[head]]) & (p == p[head])
            n = (hi - lo + 1)[order]
            i = np.flatnonzero(source)
            yield _batch([T.signed(anchor[order[i]]), T.signed(path[order[i]]), s.ids[d[i]], th[d[i]], p[i], n[i], pa.nulls(len(i), pa.binary())], ROW)
            i = np.flatnonzero(~source)
            if not len(i):
                continue
            i = i[np.lexsort((p[i], d[i]))]
            h = head[i]
            spans = [s.ids[d[i]], th[d[i]], p[i], n[i], s.ids[d[h]], th[d[h]], p[h]]
            # By rows of the slice, not by ids: a repeated row's spans stay its own.
            at = np.flatnonzero(~_follows(d[i], *spans[1:]))
            rows = np.empty(len(at), SETTLED)
            for name, x in zip(SETTLED.names, spans):
                rows[name] = x[at]
            rows["n"] = np.add.reduceat(n[i], at)
            first = np.arange(0, len(rows), PACK)
            blobs = pa.array([rows[j : j + PACK].tobytes() for j in first.tolist()], pa.binary())
            # Dealt by where they begin: by anchor, those of a hot one would meet in one task.
            deal = T.mix64(rows["doc"][first].astype(T.U64) + T.mix64(rows["lo"][first].astype(T.U64)))
            zero = np.zeros(len(first), np.int64)
            yield _batch([T.signed(deal), zero, zero, zero, zero, zero, blobs], ROW)

    return run


EDGE = "h1 long, h2 long, doc long, th long, lo int"


def _met(by_path: bool):
    """Rows sorted by two keys and coordinates: later coordinates of equal keys as REPEAT of the first ones. by_path (keys
    anchor and path): also first coordinates as BRANCH, where the anchor has several paths, and settled repeats as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # keys and source of the row before
        held = None  # the source of an anchor's only path so far
        for b in batches:
            if by_path and (packs := b.column(6).drop_null()):
                rows = np.frombuffer(b"".join(packs.to_pylist()), SETTLED)
                yield _batch([np.full(len(rows), REPEAT), *(rows[c] for c in SETTLED.names)], FOUND)
                b = b.filter(b.column(6).is_null())
            if not b.num_rows:
                continue
            a, k, doc, th, lo = (np.asarray(b.column(i)) for i in range(5))
            n = np.asarray(b.column(5)) if by_path else np.ones(len(a), np.int32)
            if last is not None:  # the source of the row before goes first
                a, k, doc, th, lo, n = (np.concatenate([[x], y]) for x, y in zip(last, (a, k, doc, th, lo, n)))
            other = np.ones(len(a), bool)  # another anchor than the row before
            other[1:] = a[1:] != a[:-1]
            new = other.copy()
            new[1:] |= k[1:] != k[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            again = (doc != doc[head]) | (th != th[head]) | (lo != lo[head])
            i = np.flatnonzero(again)
            out = [[np.full(len(i), REPEAT), doc[i], th[i], lo[i], n[i], doc[head[i]], th[head[i]], lo[head[i]]]]
            if by_path:
                first = np.flatnonzero(new)
                if last is not None:
                    first = first[first > 0]
                if held is not None and len(first):
                    if not other[first[0]]:
                        out.append([[BRANCH], *([x] for x in held), [0], [0], [0]])
                    held = None
                alone = other[first]
                branch = ~alone
                branch[:-1] |= ~other[first[1:]]
                if len(first) and alone[-1]:
                    held = tuple(x[first[-1]] for x in (doc, th, lo, n))
                    branch[-1] = False
                j = first[branch]
                zero = np.zeros(len(j), np.int64)
                out.append([np.full(len(j), BRANCH), doc[j], th[j], lo[j], n[j], zero, zero, zero])
            last = tuple(x[head[-1]] for x in (a, k, doc, th, lo, n))
            yield _batch([np.concatenate(c) for c in zip(*out)], FOUND)

    return run


def _windows(window: int):
    """Cuts the asked paths (binary of int32 pairs) of each document into windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", SLICE):
            w, codes = word_codes(s)
            asked = s.batch.column("asked").to_pylist()
            at, doc = [], []
            for i, blob in enumerate(asked):
                lo, n = np.frombuffer(blob, "<i4").astype(np.int64).reshape(-1, 2).T
                at.append(w.first[i] + T.ragged(lo, n))
                doc.append(np.full(int(n.sum()), i))
            at, doc = np.concatenate(at), np.concatenate(doc)
            order = np.argsort(at, kind="stable")
            at, doc = at[order], doc[order]
            h1, h2 = (T.window_hashes(codes, window, salt)[at] for salt in (17, 19))
            th = np.asarray(s.batch.column("th"))
            yield _batch([T.signed(h1), T.signed(h2), s.ids[doc], th[doc], at - w.first[doc]], EDGE)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc, th, lo, n) as one row per document with little-endian int32 pairs."""
    key, held = None, []
    for b in batches:
        doc, th, lo, n = (np.asarray(b.column(i)) for i in range(4))
        if not len(doc):
            continue
        pair = np.stack([lo, n], 1).astype("<i4")
        begin = T.distinct_runs(doc, th).tolist()
        out = []
        for i, j in zip(begin, [*begin[1:], len(doc)]):
            k = (int(doc[i]), int(th[i]))
            if k != key:
                if held:
                    out.append((*key, b"".join(held)))
                key, held = k, []
            held.append(pair[i:j].tobytes())
        if out:
            yield _packed(out)
    if held:
        yield _packed([(*key, b"".join(held))])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["doc", "th", "spans"])


def packed(df: DataFrame) -> DataFrame:
    p = partitions(df.sparkSession)
    return df.select("doc", "th", "lo", "n").repartition(p, "doc").sortWithinPartitions("doc", "th", "lo").mapInArrow(_pack, "doc long, th long, spans binary")


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", SLICE):
            yield pa.RecordBatch.from_arrays([s.batch.column("id"), s.batch.column("text"), pa.array(s.ids), pa.array(T.signed(text_hash(s)))], ["id", "text", "doc", "th"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, text string, doc long, th long")


RUN = np.dtype([("lo", "<i4"), ("n", "<i4"), ("sdoc", "<i8"), ("sth", "<i8"), ("slo", "<i4")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted repeats as one row per document; repeats that follow each other, like their sources, become one."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        doc, th, lo, n, sdoc, sth, slo = (np.asarray(b.column(i)) for i in range(7))
        at = np.flatnonzero(~_follows(doc, th, lo, n, sdoc, sth, slo))
        rows = np.empty(len(at), RUN)
        for name, x in (("lo", lo), ("sdoc", sdoc), ("sth", sth), ("slo", slo)):
            rows[name] = x[at]
        rows["n"] = np.add.reduceat(n, at)
        doc, th = doc[at], th[at]
        begin = T.distinct_runs(doc, th).tolist()
        out = []
        for i, j in zip(begin, [*begin[1:], len(doc)]):
            k = (int(doc[i]), int(th[i]))
            if k != key:
                if held:
                    out.append((*key, b"".join(held)))
                key, held = k, []
            held.append(rows[i:j].tobytes())
        if out:
            yield _packed(out)
    if held:
        yield _packed([(*key, b"".join(held))])


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "doc").sortWithinPartitions("doc", "th", "lo")


def repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, th, spans: for each document its repeated runs of windows with their sources (see RUN), not yet verified."""
    p = partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = base.mapInArrow(_paths(window), ROW)
    found = written(rows.repartition(p, "anchor").sortWithinPartitions("anchor", "path", "doc", "th", "lo").mapInArrow(_met(True), FOUND), "spans")

    branching = packed(found.where(F.col("kind") == BRANCH)).withColumnRenamed("spans", "asked")
    cut = hashed(docs, id_col, text_col).join(branching, ["doc", "th"]).select("id", "text", "doc", "th", "asked")
    edges = cut.mapInArrow(_windows(window), EDGE).repartition(p, "h1", "h2").sortWithinPartitions("h1", "h2", "doc", "th", "lo")
    later = found.where(F.col("kind") == REPEAT).unionByName(edges.mapInArrow(_met(False), FOUND)).drop("kind")
    return written(_dealt(later).mapInArrow(_runs, "doc long, th long, spans binary"), "runs")


def merged_spans(blob: bytes | None, window: int) -> np.ndarray:
    """Word ranges (begin, end) that runs of repeated windows cover, merged where they touch."""
    if not blob:
        return np.empty((0, 2), np.int64)
    runs = np.frombuffer(blob, RUN)
    lo, n = runs["lo"].astype(np.int64), runs["n"].astype(np.int64)
    order = np.argsort(lo, kind="stable")
    b, e = lo[order], np.maximum.accumulate((lo + n + window - 1)[order])
    new = np.ones(len(b), bool)
    new[1:] = b[1:] > e[:-1]
    begin = np.flatnonzero(new)
    return np.stack([b[begin], e[np.append(begin[1:], len(b)) - 1]], 1)


RANGE = "sdoc long, sth long, slo int, n int"
CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, ranges array<array<long>>, doc long, th long, spans binary, mine binary, asked binary, theirs binary"


def _cut(window: int):
    """Removes the repeats of each document and digests the word ranges of its repeats (mine) and of those that others
    repeat from it (theirs, for the asked ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", SLICE):
            rows = []
            for i, (spans, asked) in enumerate(zip(s.batch.column("spans").to_pylist(), s.batch.column("asked").to_pylist())):
                words = s.text(i).split()
                kept, at, ranges = [], 0, merged_spans(spans, window).tolist()
                for b, e in ranges:
                    kept += words[at:b]
                    at = e
                kept += words[at:]
                digest = lambda lo, n: hashlib.blake2b(b" ".join(words[lo : lo + n + window - 1]), digest_size=16).digest()  # noqa: E731, B023
                mine = None if spans is None else b"".join(digest(lo, n) for lo, n, *_ in np.frombuffer(spans, RUN).tolist())
                theirs = None if asked is None else b"".join(digest(lo, n) for lo, n in np.frombuffer(asked, "<i4").reshape(-1, 2).tolist())
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), ranges, mine, theirs))
            n, gone, sha, out, mine, theirs = zip(*rows)
            column = s.batch.column
            arrays = [column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(out, pa.list_(pa.list_(pa.int64()))), column("doc"), column("th"), column("spans"), pa.array(mine, pa.binary()), column("asked"), pa.array(theirs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in CUT.split(", ")])

    return run


PROOF = RANGE + ", d1 long, d2 long"


def _proofs(whose: str):
    """Distinct ranges of a batch with their digests: of the sources that repeats name (mine), or of those asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, th, spans, digests in zip(*(b.column(i).to_pylist() for i in range(4))):
                pairs = np.frombuffer(digests, "<i8").reshape(-1, 2).tolist()
                if whose == "mine":
                    out += [(r[2], r[3], r[4], r[1], *d) for r, d in zip(np.frombuffer(spans, RUN).tolist(), pairs)]
                else:
                    out += [(doc, th, *r, *d) for r, d in zip(np.frombuffer(spans, "<i4").reshape(-1, 2).tolist(), pairs)]
            if out:
                yield _batch(list(zip(*set(out))), PROOF)

    return run


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct source ranges of a batch of runs."""
    for b in batches:
        if b.num_rows:
            rows = np.unique(np.frombuffer(b"".join(b.column("spans").to_pylist()), RUN)[["sdoc", "sth", "slo", "n"]])
            yield _batch([rows[c] for c in ("sdoc", "sth", "slo", "n")], RANGE)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, th, spans, digests in zip(*(b.column(i).to_pylist() for i in range(4))):
            for r, d in zip(np.frombuffer(spans, RUN).tolist(), np.frombuffer(digests, "<i8").reshape(-1, 2).tolist()):
                out.append((doc, th, *r, *d))
        if out:
            yield _batch(list(zip(*out)), SPAN + ", d1 long, d2 long")


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and the removed word ranges (begin, end)."""
    runs = repeats(docs, window, id_col, text_col)
    while True:
        asked = runs.mapInArrow(_sources, RANGE).distinct().select(F.col("sdoc").alias("doc"), F.col("sth").alias("th"), F.col("slo").alias("lo"), "n")
        joined = hashed(docs, id_col, text_col).join(runs, ["doc", "th"], "left").join(packed(asked).withColumnRenamed("spans", "asked"), ["doc", "th"], "left")
        cut = written(joined.mapInArrow(_cut(window), CUT), "cut")
        mine = cut.where("mine is not null").select("doc", "th", "spans", "mine").mapInArrow(_proofs("mine"), PROOF).distinct()
        theirs = cut.where("theirs is not null").select("doc", "th", "asked", "theirs").mapInArrow(_proofs("theirs"), PROOF).distinct()
        wrong = mine.join(theirs, mine.columns, "left_anti")
        if wrong.isEmpty():
            return cut.select("doc_id", "n_words", "n_removed", "kept_sha256", "ranges")
        # Hashes that met by chance: those repeats remove nothing.
        rest = cut.where("mine is not null").select("doc", "th", "spans", "mine").mapInArrow(_without, SPAN + ", d1 long, d2 long").distinct()
        rest = rest.join(written(wrong, "wrong"), wrong.columns, "left_anti").drop("d1", "d2")
        runs = written(_dealt(rest).mapInArrow(_runs, "doc long, th long, spans binary"), "runs")
