"""Benchmark decontamination by SimHash windows, multi-index Hamming search and exact weighted-shingle similarity.

The benchmark is the query set. Its items go to the tasks in blocks of at most ITEMS items and about ITEM_BYTES of text,
one pass over the documents each, so an index is bounded whatever the benchmark's size; beside it go the shingles that
at least two items of the whole benchmark hold, as weights are the same in every block. Words are lower-cased, without
outer punctuation; texts are compared by their 5-word shingles, a shingle weighing log(1 + items / items that hold it).

For each item length, windows of that many words slide over a document. Only windows that hold some shingle of an item
of their length can have a similarity above 0 with one, so the others are skipped without loss. A window's 64-bit
SimHash (sign of the sums of shingle bits times the roots of the weights, from running sums; the roots make its cosine
the weighted overlap, which is at least 2 s / (1 + s) at a similarity of s for windows without repeated shingles) is
looked up in a multi-index that is split by item length: fingerprints are cut into BLOCKS blocks of 16 bits, and a pair
within RADIUS bits has a block within RADIUS // BLOCKS bits. Items are listed under their blocks with up to OWN bits
flipped, windows probe theirs with the rest, so every item within the radius is found, while a random fingerprint of the
same length reaches 4 of 100. At the threshold itself the expected distance is 9.7 bits with a deviation of 2.9, so the
radius finds 97 of 100 such pairs, and nearly all of the more similar ones; tests measure the recall against all windows.
Exact weighted Jaccard similarity of the shingle multisets decides.

One row per doc_id and item_id: the most similar window, the first one of ties, whatever rows repeat an id. Items of
fewer than 5 words are one shingle of their own length. A document shorter than an item is one window. Null or empty
texts match nothing. Null ids are one id. Empty tables: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .toxicity import trimmed

ITEMS, ITEM_BYTES = 5000, 16 << 20
RADIUS, BLOCKS, OWN = 15, 4, 2
#: Words whose running sums are held at once.
SPAN = 8192
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"
_BITS = np.arange(64, dtype=np.uint64)


def codes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[T.Words, np.ndarray]:
    w = T.words(data, offsets)
    if not len(w.starts):
        return w, np.empty(0, np.uint64)
    return w, T.span_hashes(data, *trimmed(data, w))


def shingles(codes: np.ndarray, k: int) -> np.ndarray:
    if not len(codes):
        return np.empty(0, np.uint64)
    return T.window_hashes(codes, min(k, len(codes)), 31)


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of a hash: len x 64."""
    return (h[:, None] >> _BITS & np.uint64(1)).astype(np.float64) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(-1, dtype=np.uint64)


class Weights:
    """Shingle weights over the whole benchmark. A shingle of one item weighs as much as one of none, so only those of
    several items are listed."""

    def __init__(self, shared: np.ndarray, df: np.ndarray, n: int):
        order = np.argsort(shared)
        self.shared, self.weight, self.fresh = shared[order], np.log1p(n / df[order]), float(np.log1p(max(n, 1)))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(h), self.fresh)
        k = np.minimum(np.searchsorted(self.shared, h), len(self.shared) - 1)
        return np.where(self.shared[k] == h, self.weight[k], self.fresh)


def weights(items: DataFrame, k: int) -> Weights:
    """Counts the items that have words, and those that hold each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "item_id", "text", lower=True):
            w, codes = codes_of(s.data, s.offsets)
            sets = [np.unique(shingles(codes[a:b], k)) for a, b in zip(w.first[:-1], w.first[1:]) if b > a]
            h = T.signed(np.concatenate([np.empty(0, np.uint64), *sets]))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h, np.zeros(len(sets), np.int64)), mask=np.arange(len(h) + len(sets)) >= len(h))], ["h"])

    # The null group is the number of items.
    found = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("h is null or n > 1").toArrow()
    h, n = found.column("h"), np.asarray(found.column("n"), np.int64)
    null = np.asarray(h.is_null())
    return Weights(np.asarray(h.filter(pa.array(~null)), np.int64).view(np.uint64), n[~null], int(n[null].sum()))


def flips(width: int, most: int) -> np.ndarray:
    """All masks of a block with at most so many bits."""
    return np.array([sum(1 << b for b in c) for r in range(most + 1) for c in combinations(range(width), r)], np.int64)


class Index:
    """A block of items: the multi-index over their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], k: int, threshold: float, weights: Weights, radius: int = RADIUS, blocks: int = BLOCKS):
        self.weights = weights
        self.k, self.threshold, self.radius = k, threshold, radius
        self.ids, self.sets, lengths = [], [], []
        for key, text in items:
            raw = np.frombuffer(pc.utf8_lower(pa.scalar(text or "")).as_py().encode(), np.uint8)
            _, codes = codes_of(raw, np.array([0, len(raw)]))
            if len(codes):
                self.ids.append(key)
                self.sets.append(shingles(codes, k))
                lengths.append(len(codes))
        self.lengths = np.array(lengths, np.int64)
        n = len(self.ids)
        self.known = known = np.unique(np.concatenate([np.empty(0, np.uint64), *self.sets]))
        self.filled = np.zeros(1 << 20, bool)
        self.filled[known >> np.uint64(44)] = True
        # Shingle -> item lengths that hold it, as CSR over (known, length).
        at = np.concatenate([np.searchsorted(known, np.unique(s)) for s in self.sets] or [np.empty(0, np.int64)])
        of = np.repeat(self.lengths, [len(np.unique(s)) for s in self.sets]) if n else np.empty(0, np.int64)
        pair = np.unique(np.stack([at, of], 1), axis=0) if n else np.empty((0, 2), np.int64)
        self.len_ptr, self.len_of = np.searchsorted(pair[:, 0], np.arange(len(known) + 1)), pair[:, 1]
        self.prints = np.array([fingerprint((signs(s) * np.sqrt(self.weights(s))[:, None]).sum(0)) for s in self.sets], np.uint64)
        self.width = 64 // blocks
        self.probes = flips(self.width, max(0, radius // blocks - OWN))
        own = flips(self.width, min(OWN, radius // blocks))
        self.table = []
        for b in range(blocks):
            key = (self.part(self.prints, b, self.lengths)[:, None] ^ own[None, :]).ravel()
            order = np.argsort(key, kind="stable")
            self.table.append((key[order], np.repeat(np.arange(n, dtype=np.int32), len(own))[order]))

    def part(self, prints: np.ndarray, block: int, length) -> np.ndarray:
        """A block of fingerprints below the items' length."""
        return (prints >> np.uint64(block * self.width) & np.uint64((1 << self.width) - 1)).astype(np.int64) | np.int64(length) << self.width

    def near(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs (place of a fingerprint, item of that length) within the radius, and their distances."""
        pairs = []
        for b, (keys, items) in enumerate(self.table):
            asked = (self.part(prints, b, length)[:, None] ^ self.probes[None, :]).ravel()
            lo, hi = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
            hit = np.flatnonzero(hi > lo)
            size = hi[hit] - lo[hit]
            pairs.append(np.repeat(hit // len(self.probes), size) * len(self.ids) + items[T.ragged(lo[hit], size)])
        at, item = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.ids)))
        distance = np.bitwise_count(prints[at] ^ self.prints[item]).astype(np.int64)
        ok = distance <= self.radius
        return at[ok], item[ok], distance[ok]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of two shingle multisets."""
        u, inv = np.unique(np.concatenate([window, self.sets[item]]), return_inverse=True)
        a = np.bincount(inv[: len(window)], minlength=len(u))
        b = np.bincount(inv[len(window) :], minlength=len(u))
        w = self.weights(u)
        return float((w * np.minimum(a, b)).sum() / (w * np.maximum(a, b)).sum())

    def search(self, codes: np.ndarray, hits: dict[int, np.ndarray]) -> list[tuple[int, int, int, int, float]]:
        """Best windows of a document: item, start, words, distance, similarity. hits: shingle length -> positions."""
        n, best = len(codes), {}
        for k, at in hits.items():
            h = T.window_hashes(codes, k, 31)
            spot = np.searchsorted(self.known, h[at])
            pairs = [(i, length) for i, s in zip(at.tolist(), spot.tolist()) for length in self.len_of[self.len_ptr[s] : self.len_ptr[s + 1]].tolist() if min(self.k, length) == k]
            for length in sorted({length for _, length in pairs}):
                size = min(length, n)
                mask = np.zeros(n - size + 2, np.int64)
                for i in (i for i, m in pairs if m == length):
                    mask[max(0, i - size + k)] += 1
                    mask[min(i, n - size) + 1] -= 1
                starts, count, a = np.flatnonzero(np.cumsum(mask[:-1]) > 0), size - k + 1, 0
                while a < len(starts):  # a part of a long text at a time is expanded to bits
                    b = int(np.searchsorted(starts, starts[a] + SPAN, "left"))
                    lo, hi = int(starts[a]), int(starts[b - 1]) + count
                    sums = np.zeros((hi - lo + 1, 64))
                    np.cumsum(signs(h[lo:hi]) * np.sqrt(self.weights(h[lo:hi]))[:, None], axis=0, out=sums[1:])
                    part = starts[a:b]
                    at_, item, distance = self.near(fingerprint(sums[part + count - lo] - sums[part - lo]), length)
                    for start, i, d in zip(part[at_].tolist(), item.tolist(), distance.tolist()):
                        sim = self.similarity(h[start : start + count], i)
                        if sim >= self.threshold - 1e-12 and (i not in best or (sim, -start) > (best[i][4], -best[i][1])):
                            best[i] = (i, start, size, d, sim)
                    a = b
        return list(best.values())


def matches(s: T.Slice, index: Index) -> list[tuple]:
    """Best windows of a slice of lower-cased texts: document (place in the slice), item id, start, words, distance,
    similarity."""
    w, codes = codes_of(s.data, s.offsets)
    hits: dict[int, dict[int, np.ndarray]] = {}
    for k in sorted({min(index.k, int(n)) for n in index.lengths}):
        h = T.window_hashes(codes, k, 31)
        ok = np.flatnonzero(T.inside(w.first, k, len(h)) & index.filled[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(index.known, h[ok]), len(index.known) - 1)
        ok = ok[index.known[at] == h[ok]]
        doc = np.searchsorted(w.first, ok, "right") - 1
        for d in np.unique(doc).tolist():
            hits.setdefault(d, {})[k] = ok[doc == d] - w.first[d]
    rows = []
    for d, found in sorted(hits.items()):
        best: dict[int, tuple] = {}
        for i, start, size, distance, sim in index.search(codes[w.first[d] : w.first[d + 1]], found):
            row = (d, index.ids[i], start, size, distance, sim)
            if row[1] not in best or (sim, -start) > (best[row[1]][5], -best[row[1]][2]):
                best[row[1]] = row
        rows += best.values()
    return rows


def _pass(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", 2 << 20, lower=True):
            if rows := matches(s, index):
                d, *rest = zip(*rows)
                ids = s.batch.column("id").take(pa.array(d))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())))], ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

    return run


def indexes(items: DataFrame, k: int, threshold: float) -> Iterator[Index]:
    """The blocks of the benchmark that have an item with words."""
    common = weights(items, k)
    block: list[tuple] = []
    size = 0
    for key, text in items.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        block.append((key, text))
        size += len(text)
        if len(block) == ITEMS or size >= ITEM_BYTES:
            yield from _filled(Index(block, k, threshold, common))
            block, size = [], 0
    yield from _filled(Index(block, k, threshold, common))


def _filled(index: Index) -> list[Index]:
    return [index] if index.ids else []


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, start_word, n_words, distance, similarity."""
    base = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    passes = [base.mapInArrow(_pass(index), SCHEMA) for index in indexes(items, k, threshold)]
    if not passes:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start_word", "n_words", "distance"))
    rows = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return rows.select("doc_id", "item_id", "b.start_word", "b.n_words", "b.distance", (-F.col("b.s")).alias("similarity"))
