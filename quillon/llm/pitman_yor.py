"""Hierarchical Pitman-Yor language model with Chinese-restaurant seating sampled by Gibbs.

Restaurants. The context of a token is its preceding word; each word has its own restaurant, known by 64 bits: 58 of the
hash of the whole word below 6 of the hash of its last bytes, its family. Restaurants of one family share a parent,
families share the root, and the root's base measure is uniform over the known tokens and one unknown. The number of
families is a parameter of the model; restaurants, dishes (words) and seatings grow with the corpus.

Sharding by dish. All customers of a word, whatever the restaurant, lie in one shard, so a word's seatings on all three
levels and its predictive probabilities are computed in one place. What restaurants share across words (customers and
tables in each) is sharded by context: after each sweep a shard sends its sums, and is sent the totals of the contexts
it knows or is asked for by documents that are not learnt from. Only those of families and root pass the driver.

Gibbs. A sweep takes each party (a word's customers in one restaurant) out of its restaurant and seats it again, level
by level from the leaves up, given the other parties' tables there and the parents' probabilities of the sweep before:
one customer after another opens a table with weight (strength + discount * tables there) * parent's probability, else
joins one of the party's. From the 32nd customer on a step seats 1 + seated / 32 customers at the weights of its
beginning, at every size alike. Draws are functions of (word, restaurant, sweep, step), and all sums are integers, so
scores are the same however the corpus is partitioned or sharded. After BURN_IN sweeps the predictive probabilities of
SAMPLES sweeps are averaged; perplexity is 10 ** (-score / n_tokens). Discounts are n1 / (n1 + 2 n2) of each level's
customer counts.

Traffic. Slices of documents send, for each shard, packed arrays: for counting, distinct (word, context) pairs with
counts, so a hot word costs a slice at most its distinct contexts; for scoring, (word, context, document) triples, from which a
shard returns three sums per document; the shards are asked in ROUNDS. Texts are never shuffled. Seatings are written after each sweep. There is a shard
for each SHARD_BYTES of text at least, so a shard's memory does not grow with the corpus.

Documents whose fold is held out are scored only. Null id: held_out null, not learnt from. Null or empty text: the end
token alone. Repeated rows: learnt as often as they occur, one result each. Empty table or no training row: no known
token, probability 1 of the unknown token. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .spark_util import bounded_batches, partitions, removed, written

FAMILY_BITS = 6
FAMILIES = 1 << FAMILY_BITS
_FAMILY = np.uint64(64 - FAMILY_BITS)  # where a context's family begins
STRENGTH = (2.0, 5.0, 10.0)  # leaves, families, root
BURN_IN, SAMPLES, SEED = 1, 2, np.uint64(20240607)
#: Customers that are seated one by one; each later step seats a 32nd of those seated.
SINGLY = 32
SLICE = 6 << 20
#: Of an Arrow batch: a batch of documents is one slice, and a shard's blobs come a few at a time.
BATCH = SLICE - (SLICE >> 4)
#: Text of a shard at most, on average.
SHARD_BYTES = 10 << 20
#: Log probabilities are summed as integers of this unit, so that the order of the sums doesn't matter.
UNIT = 2.0**-34
END = np.uint64(0xE5D0C5D0E5D0C5D1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob with their types and lengths."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for part in raw[4:at].decode().split(";"):
        kind, size = part.split(",")
        a = np.frombuffer(raw, kind, int(size), at)
        at += a.nbytes
        out.append(a)
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds x."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


class Tokens:
    """A slice's tokens by document, ends included: distinct words and contexts, and for each token the places of its
    word and context among them, and its document; size: tokens of each document."""

    def __init__(self, s: T.Slice):
        data = T.LOWER[s.data]
        w = T.words(data, s.offsets)
        codes = T.span_hashes(data, w.starts, w.ends, 41)
        order = np.argsort(codes)
        new = T.distinct_runs(codes[order])
        self.words, at, inverse = codes[order[new]], order[new], np.empty(len(codes), np.int64)
        inverse[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(codes))))
        tail = T.span_hashes(data, np.maximum(w.starts, w.ends - 3)[at], w.ends[at], 43)
        own = tail >> _FAMILY << _FAMILY | self.words & ((np.uint64(1) << _FAMILY) - np.uint64(1))
        # The context of a document's first token is the end of another: restaurant 0. Contexts are sorted.
        self.contexts = np.append(own, np.uint64(0))
        order = np.argsort(self.contexts)
        self.contexts, place = self.contexts[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.size = np.diff(w.first) + 1
        first = np.cumsum(self.size) - self.size
        is_end = np.zeros(len(codes) + len(s.ids), bool)
        is_end[first + self.size - 1] = True
        self.word = np.full(len(is_end), len(self.words), np.int64)
        self.word[~is_end] = inverse
        self.words = np.append(self.words, END)
        self.ctx = np.full(len(is_end), place[-1], np.int64)
        follow = np.ones(len(is_end), bool)
        follow[first] = False
        self.ctx[follow] = place[inverse]
        self.doc = np.repeat(np.arange(len(s.ids)), self.size)

    def ordered(self, keep: np.ndarray | None = None) -> np.ndarray:
        """Tokens (of the words that keep marks) by word, context and document."""
        at = np.arange(len(self.word)) if keep is None else np.flatnonzero(keep[self.word])
        wide, deep = len(self.contexts).bit_length(), len(self.word).bit_length()
        if 2 * wide + deep <= 63:  # one key sorts faster than three
            key = np.sort((self.word[at] << wide | self.ctx[at]) << deep | at)
            return key & ((1 << deep) - 1)
        return at[np.lexsort((self.ctx[at], self.word[at]))]


def folds(ids: np.ndarray) -> np.ndarray:
    """crc32 of the id as text modulo 10; -1 for null."""
    return np.array([-1 if i == T.NULL_ID else zlib.crc32(str(i).encode()) % 10 for i in ids.tolist()])


def shard_of(code: np.ndarray, shards: int) -> np.ndarray:
    return ((code >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def _listed(contexts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts that are used, and the place of each use among them; rank: places among all."""
    used = np.zeros(len(contexts), bool)
    used[rank] = True
    return contexts[used], _small((np.cumsum(used, dtype=np.int32) - 1)[rank])


def _dealt(ctxs: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of contexts by the shard that keeps their totals, shards present and where each begins."""
    s = shard_of(ctxs << np.uint64(FAMILY_BITS), shards)
    order = np.argsort(s.astype(np.uint16) if shards < 1 << 16 else s, kind="stable")
    at = T.distinct_runs(s[order])
    return order, s[order][at], np.append(at, len(s))


def _blobs(x: Tokens, word: np.ndarray, ctx: np.ndarray, shards: int, more, columns: dict) -> Iterator[pa.RecordBatch]:
    """Rows (shard, columns..., blob): distinct words, how many rows each has, contexts, place of each row's, and what
    more(begin, end) adds. word, ctx: places sorted by word; END is the last one, wherever its code sorts."""
    cut = np.append(T.distinct_runs(shard_of(x.words[word], shards)), len(word))
    present, blobs = shard_of(x.words[word[cut[:-1]]], shards), []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        new = T.distinct_runs(word[a:b])
        blobs.append(_pack(x.words[word[a:b][new]], _small(np.diff(np.append(new, b - a))), *_listed(x.contexts, ctx[a:b]), *more(a, b)))
    if blobs:
        yield pa.RecordBatch.from_arrays([pa.array(present), *(pa.array(np.full(len(blobs), v)) for v in columns.values()), pa.array(blobs, pa.binary())], ["shard", *columns, "blob"])


def _count(shards: int):
    """(shard, blob): distinct words, number of contexts of each, contexts, place of each pair's, counts (0: not learnt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", SLICE):
            x = Tokens(s)
            order = x.ordered()
            word, ctx, learn = x.word[order], x.ctx[order], (folds(s.ids) > 0)[x.doc[order]]
            pair = T.distinct_runs(word, ctx)
            count = np.add.reduceat(learn.astype(np.int64), pair)
            yield from _blobs(x, word[pair], ctx[pair], shards, lambda a, b, count=count: [_small(count[a:b])], {})

    return run


def _by_shard(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows grouped by the sorted first column; a group is one shard's blobs."""
    key, held = None, []
    for b in batches:
        for k, *rest in zip(*(b.column(n).to_pylist() for n in names)):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(tuple(rest))
    if held:
        yield key, held


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model row per shard: sorted words, number of contexts of each, contexts (also those asked for), place of each
    pair's, counts."""
    for shard, rows in _by_shard(batches, ("shard", "blob")):
        rows.reverse()
        parts = [_unpack(rows.pop()[0]) for _ in range(len(rows))]  # a blob goes as soon as it is unpacked
        words, contexts = (np.unique(np.concatenate([p[i] for p in parts])) for i in (0, 2))
        key = np.concatenate([np.repeat(np.searchsorted(words, p[0]), p[1]) << 32 | np.searchsorted(contexts, p[2])[p[3]] for p in parts])
        count = np.concatenate([p[4].astype(np.int64) for p in parts])
        del parts
        order = np.argsort(key)
        key, count = key[order], count[order]
        pair = T.distinct_runs(key)
        count, key = np.add.reduceat(count, pair), key[pair]
        code, ctx = words[key >> 32], contexts[key & 0xFFFFFFFF]
        known, learnt = contexts, count > 0
        code, ctx, count = code[learnt], ctx[learnt], count[learnt]
        word = T.distinct_runs(code)
        size = np.diff(np.append(word, len(code)))
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([_pack(code[word], _small(size), known, _small(np.searchsorted(known, ctx)), _small(count))], pa.binary()), pa.array([int(count.sum())]), pa.array([len(word)])], ["shard", "blob", "n", "v"])


class Shard:
    """A shard's words and customers on three levels; level 0: leaves, 1: families, 2: root."""

    def __init__(self, shard: int, blob: bytes, vocabulary: int):
        self.shard, self.base = shard, 1.0 / (vocabulary + 1)
        self.words, size, self.contexts, self.local, count = _unpack(blob)
        word = np.repeat(np.arange(len(self.words)), size)
        ctx = self.contexts[self.local]
        self.key = [(self.contexts, word << 32 | self.local)]
        up = word << FAMILY_BITS | (ctx >> _FAMILY).astype(np.int64)
        at = T.distinct_runs(up)
        self.key += [up[at], np.arange(len(self.words))]
        root = T.distinct_runs(word[at])
        self.begin = [at, root]  # where each parent's children begin
        self.parent = [np.repeat(np.arange(len(at)), np.diff(np.append(at, len(up)))), np.repeat(np.arange(len(root)), np.diff(np.append(root, len(at))))]
        self.place = [ctx, (up[at] & (FAMILIES - 1)), np.zeros(len(self.words), np.int64)]
        self.count = np.add.reduceat(count.astype(np.int64), at[root])  # of each word
        self.c = [count.astype(np.int64), None, None]
        self.t = [np.ones(len(count), np.int64), None, None]
        self.restore([self.t[0], np.ones(len(at), np.int64), np.ones(len(self.words), np.int64)])

    def restore(self, tables: list[np.ndarray]) -> None:
        """Takes the tables of the three levels; children's tables are the parents' customers."""
        self.t = [t.astype(np.int64) for t in tables]
        for level in (0, 1):
            self.c[level + 1] = np.add.reduceat(self.t[level], self.begin[level])

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables here of each context."""
        return tuple(np.bincount(self.local, x, len(self.contexts)).astype(np.int64) for x in (self.c[0], self.t[0]))

    def totals(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per level: restaurants with customers here, their customers and tables."""
        c, t = self.leaves()
        at = np.flatnonzero(c)
        out = [(0, self.contexts[at], c[at], t[at])]
        for level, n in ((1, FAMILIES), (2, 1)):
            c = np.bincount(self.place[level], self.c[level], n).astype(np.int64)
            t = np.bincount(self.place[level], self.t[level], n).astype(np.int64)
            at = np.flatnonzero(c)
            out.append((level, at, c[at], t[at]))
        return out

    def shared(self, level: int, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each dish's restaurant."""
        if level:
            return totals.c[level][self.place[level]], totals.t[level][self.place[level]]
        c, t = totals.leaves(self.contexts)
        return c[self.local], t[self.local]

    def predict(self, level: int, totals: Totals, parent: np.ndarray) -> np.ndarray:
        """Probability of each dish of a level in its restaurant, given its parent's probability."""
        c, t = self.shared(level, totals)
        d, s = totals.discount[level], STRENGTH[level]
        return (self.c[level] - d * self.t[level] + (s + d * t) * parent) / (s + c)

    def parents(self, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the dishes of families and the root."""
        root = self.predict(2, totals, np.full(len(self.words), self.base))
        return self.predict(1, totals, root[self.parent[1]]), root

    def probabilities(self, totals: Totals) -> list[np.ndarray]:
        """Of the dishes of each level."""
        family, root = self.parents(totals)
        return [self.predict(0, totals, family[self.parent[0]]), family, root]

    def sweep(self, number: int, totals: Totals) -> None:
        """Seats all parties anew, given the totals and probabilities of the sweep before."""
        family, root = self.parents(totals)
        above = [lambda i: family[self.parent[0][i]], lambda i: root[self.parent[1][i]], lambda i: np.full(len(i), self.base)]
        for level in range(3):
            if level:
                self.c[level] = np.add.reduceat(self.t[level - 1], self.begin[level - 1])
            several = np.flatnonzero(self.c[level] > 1)  # one customer sits alone
            d, s, p = totals.discount[level], STRENGTH[level], above[level](several)
            others = totals.t[level][(self.local if not level else self.place[level])[several]] - self.t[level][several]
            seed = T.mix64(self.seed(level, several) ^ (SEED + np.uint64(number)))
            tables = np.ones(len(self.c[level]), np.int64)
            tables[several] = seat(self.c[level][several], (s + d * others) * p, d * p, d, seed)
            self.t[level] = tables

    def seed(self, level: int, at: np.ndarray) -> np.ndarray:
        """A number of each party's word and restaurant."""
        word = self.key[0][1][at] >> 32 if not level else self.key[1][at] >> FAMILY_BITS if level == 1 else at
        return T.mix64(self.words[word] ^ T.mix64(self.place[level][at].astype(np.uint64) + np.uint64(level + 1)))


def seat(customers: np.ndarray, new: np.ndarray, more: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """Tables of parties of customers of one dish each; new: weight of opening a table, and more by each of the party's
    tables. A step's expected tables are rounded up or down at random, which for one customer is a coin."""
    order = np.argsort(-customers, kind="stable")
    c, w, v, key = customers[order], new[order], more[order], seed[order]
    t = np.ones(len(c), np.float64)
    seated, step, m = 1, 0, int(np.searchsorted(-c, -1, "left"))
    while m:
        block = np.minimum(1 + seated // SINGLY, c[:m] - seated)
        weight = w[:m] + v[:m] * t[:m]
        coin = (T.mix64(key[:m] + np.uint64(step)) >> np.uint64(11)) * 2.0**-53
        t[:m] += np.floor(block * (weight / (weight + np.maximum(seated - discount * t[:m], 1e-12))) + coin)
        seated += 1 + seated // SINGLY
        step += 1
        m = int(np.searchsorted(-c, -seated, "left"))
    tables = np.ones(len(customers), np.int64)
    tables[order] = np.minimum(t.astype(np.int64), c)
    return tables


class Totals:
    """Customers and tables of restaurants of the three levels (of the leaves those listed), and the discounts."""

    def __init__(self, rows: list[tuple[int, int, int, int]], discount: tuple[float, float, float]):
        self.discount = discount
        leaf = sorted(r[1:] for r in rows if r[0] == 0)
        self.contexts = np.array([r[0] for r in leaf], np.uint64)
        self.c = [np.array([r[1] for r in leaf], np.int64), np.zeros(FAMILIES, np.int64), np.zeros(1, np.int64)]
        self.t = [np.array([r[2] for r in leaf], np.int64), np.zeros(FAMILIES, np.int64), np.zeros(1, np.int64)]
        for level, place, c, t in rows:
            if level:
                self.c[level][place] = c
                self.t[level][place] = t

    def with_leaves(self, contexts: np.ndarray, c: np.ndarray, t: np.ndarray) -> Totals:
        out = Totals([], self.discount)
        out.contexts, out.c, out.t = contexts, [c, *self.c[1:]], [t, *self.t[1:]]
        return out

    def leaves(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of contexts; none of those that are not listed."""
        if contexts is self.contexts:
            return self.c[0], self.t[0]
        if not len(self.contexts):
            return np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        hit = self.contexts[at] == contexts
        return self.c[0][at] * hit, self.t[0][at] * hit


MODEL, STATE, TOTALS = 0, 1, 2


def _loaded(x: Shard, kind: int, rows: list[tuple], head: Totals, shards: int) -> Totals:
    """Restores a shard's seating from its rows (kind, slice, blob): kind is the seating's, the next one its totals'."""
    x.restore(_unpack(next(blob for k, _, blob in rows if k == kind)))
    order, _, _ = _dealt(x.contexts, shards)
    parts = [_unpack(blob) for k, _, blob in rows if k == kind + 1]
    c, t = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    if parts:
        c[order], t[order] = (np.concatenate(p) for p in zip(*parts))
    return head.with_leaves(x.contexts, c, t)


def _seated(vocabulary: int, number: int, head: Totals | None, shards: int):
    """(kind, place, shard, blob). STATE: a shard's seating, after another sweep if there are totals; TOTALS: its contexts,
    customers and tables, for the shards that sum them; place -1: sums of the other levels and how many dishes of each
    level have 1 and 2 customers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(n, np.int64) for n in (FAMILIES, FAMILIES, 1, 1, 6)]

        def rows(kind: int, place: np.ndarray, shard: int, blobs: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), kind, np.int32)), pa.array(place), pa.array(np.full(len(blobs), shard)), pa.array(blobs, pa.binary())], ["kind", "place", "shard", "blob"])

        for shard, held in _by_shard(batches, ("shard", "kind", "slice", "blob")):
            x = Shard(shard, held[0][2], vocabulary)
            if head is not None:
                x.sweep(number, _loaded(x, STATE, held, head, shards))
            del held
            for level, at, c, t in x.totals()[1:]:
                sums[2 * level - 2][at] += c
                sums[2 * level - 1][at] += t
            sums[4] += [(c == n).sum() for c in x.c for n in (1, 2)]
            c, t = x.leaves()
            order, present, cut = _dealt(x.contexts, shards)
            yield rows(TOTALS, present, shard, [_pack(x.contexts[o], _small(c[o]), _small(t[o])) for o in np.split(order, cut[1:-1])] if len(present) else [])
            yield rows(STATE, np.array([shard]), shard, [_pack(*map(_small, x.t))])
        yield rows(TOTALS, np.array([-1]), -1, [_pack(*sums)])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals over all shards, sent back to each shard in the order of its contexts; shard -1: the other levels."""
    for place, rows in _by_shard(batches, ("place", "shard", "blob")):
        parts = [_unpack(blob) for _, blob in rows]
        if place < 0:
            to, blobs = [-1], [_pack(*(np.sum(x, 0) for x in zip(*parts)))]
        else:
            u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c, t = (np.bincount(at, np.concatenate([p[k] for p in parts]), len(u)).astype(np.int64) for k in (1, 2))
            to = [shard for shard, _ in rows]
            blobs = [_pack(_small(c[a]), _small(t[a])) for a in np.split(at, np.cumsum([len(p[0]) for p in parts])[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(to), place)), pa.array(blobs, pa.binary())], ["shard", "slice", "blob"])


def _kinds(model: DataFrame, seatings: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The model, seatings and their totals as rows (shard, kind, slice, blob), kinds in this order."""
    rows = model.select("shard", F.lit(MODEL).alias("kind"), F.lit(0).cast("long").alias("slice"), "blob")
    for i, (state, reply) in enumerate(seatings):
        rows = rows.unionByName(state.select("shard", F.lit(2 * i + STATE).alias("kind"), F.lit(0).cast("long").alias("slice"), "blob"))
        rows = rows.unionByName(reply.where("shard >= 0").select("shard", F.lit(2 * i + TOTALS).alias("kind"), "slice", "blob"))
    return rows


def _placed(rows: DataFrame, shards: int, by: str) -> DataFrame:
    """A partition for each shard: dealt by hash, several large ones would meet in one task."""
    return rows.repartitionById(shards, F.col(by).cast("int"))


def _sorted(rows: DataFrame, shards: int) -> DataFrame:
    return _placed(rows, shards, "shard").sortWithinPartitions("shard", "kind", "slice")


def _swept(model: DataFrame, vocabulary: int, number: int, before: tuple[DataFrame, DataFrame] | None, head: Totals | None, shards: int) -> tuple[DataFrame, DataFrame, Totals]:
    """The seating after a sweep (the first one: before any), its contexts' totals, and those of families and the root."""
    rows = _sorted(_kinds(model, [before] if before else []), shards)
    sent = written(rows.mapInArrow(_seated(vocabulary, number, head, shards), "kind int, place long, shard long, blob binary"), "seating", "kind")
    asked = sent.where(F.col("kind") == TOTALS).drop("kind")
    out = written(_placed(asked, shards, "place").sortWithinPartitions("place", "shard").mapInArrow(_summed, "shard long, slice long, blob binary"), "totals")
    removed(sent, f"kind={TOTALS}")
    row = out.where("shard < 0").first()
    *sums, n = _unpack(row["blob"]) if row else [np.empty(0, np.int64)] * 4 + [np.zeros(6, np.int64)]
    discount = head.discount if head else tuple(min(0.95, max(0.05, int(a) / max(1, int(a + 2 * b)))) if a + b else 0.5 for a, b in n.reshape(3, 2))
    found = Totals([(level, i, int(c), int(t)) for level in (1, 2) for i, (c, t) in enumerate(zip(sums[2 * level - 2], sums[2 * level - 1]))], discount)
    return sent.where(F.col("kind") == STATE).select("shard", "blob"), out, found


#: The kind of a slice's tokens; those of a shard come before.
ASKED = 1 << 20
SCORE = "shard long, kind int, slice long, blob binary"


#: Parts of the shards that are asked one after another, so that the tokens on their way take a part of the disk.
ROUNDS = 2


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, T.Slice]]:
    """Slices with numbers that are the same whenever a task runs again."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    for s in T.slices(batches, "id", "text", SLICE):
        yield number, s
        number += 1


def _ask(shards: int, part: int):
    """Tokens of each slice for the shards of a round, sorted by word, context and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, s in _numbered(batches):
            x = Tokens(s)
            order = x.ordered(shard_of(x.words, shards) % ROUNDS == part)
            doc, n = x.doc[order], np.array([len(s.ids)])
            yield from _blobs(x, x.word[order], x.ctx[order], shards, lambda a, b, doc=doc, n=n: [_small(doc[a:b]), n], {"kind": np.int32(ASKED), "slice": np.int64(number)})

    return run


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's ids, tokens per document and folds."""
    for number, s in _numbered(batches):
        size = np.diff(T.words(s.data, s.offsets).first) + 1
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([0], pa.int32()), pa.array([_pack(s.ids, size, folds(s.ids))], pa.binary())], ["slice", "kind", "blob"])


def _answer(vocabulary: int, n_tokens: int, heads: list[Totals], shards: int):
    """Shards' rows, the model and totals first: sums per document of known tokens, base and model log10 probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for b in batches:
            for k, kind, number, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                if kind != ASKED:
                    if k != shard:
                        shard, held, samples = k, [], []
                    held.append((kind, number, blob))
                    continue
                if held:  # every word that is asked for was counted, so each shard has a model
                    x = Shard(k, held[0][2], vocabulary)
                    for i, head in enumerate(heads):
                        totals = _loaded(x, 2 * i + STATE, held, head, shards)
                        samples.append((x.probabilities(totals), totals))
                    words, count, keys, held = x.words, x.count, x.key[:2], []
                    del x
                code, size, ctx, local, doc, n_docs = _unpack(blob)
                at = np.searchsorted(words, code)
                at[at == len(words)] = 0
                known = (words[at] == code) if len(words) else np.zeros(len(code), bool)
                c = np.where(known, count[at], 0) if len(words) else np.zeros(len(code))
                base = np.rint(np.log10((c + 0.1) / (n_tokens + 0.1 * (vocabulary + 1))) / UNIT)
                # Equal pairs of word and context lie together: each is looked up once.
                of = np.repeat(np.arange(len(code)), size)
                pair = T.distinct_runs(of, local)
                p = predictive(np.where(known, at, -1)[of[pair]], ctx, keys, samples, vocabulary, local[pair])
                p = np.repeat(np.rint(np.log10(p) / UNIT), np.diff(np.append(pair, len(of))))
                sums = [_summed_by(doc, x, int(n_docs[0])) for x in ((c > 0)[of], base[of], p)]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_pack(*sums)], pa.binary())], ["slice", "blob"])

    return run


def _summed_by(doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by document."""
    if len(x) < 1 << 14:  # far below what doubles hold exactly
        return np.bincount(doc, x, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, doc, x.astype(np.int64))
    return out


def predictive(word: np.ndarray, ctx: np.ndarray, keys: list, samples: list, vocabulary: int, local: np.ndarray | None = None) -> np.ndarray:
    """Averaged probability of tokens (word: index in the shard, or -1 if unknown); local: the places of the tokens'
    contexts in ctx."""
    ctx = ctx.astype(np.uint64)
    if local is None:
        ctx, local = np.unique(ctx, return_inverse=True)
    contexts, pairs = keys[0]
    own = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
    own = np.where(contexts[own] == ctx, own, len(contexts))[local]
    family = (ctx >> _FAMILY).astype(np.int64)[local]
    found = []
    for key, asked in ((pairs, word << 32 | own), (keys[1], word << FAMILY_BITS | family)):
        at = np.minimum(np.searchsorted(key, asked), max(0, len(key) - 1))
        found.append((at, (key[at] == asked) & (word >= 0) if len(key) else np.zeros(len(asked), bool)))
    out = np.zeros(len(word))
    for (leaf, fam, root), totals in samples:
        unknown = 1.0 / (vocabulary + 1)
        d, s = totals.discount[2], STRENGTH[2]
        rest = (s + d * totals.t[2][0]) / (s + totals.c[2][0]) * unknown
        p = np.where(word >= 0, root[np.maximum(word, 0)] if len(root) else rest, rest)
        c, t = totals.leaves(ctx)
        for level, values, c, t in ((1, fam, totals.c[1][family], totals.t[1][family]), (0, leaf, c[local], t[local])):
            at, hit = found[level]
            d, s = totals.discount[level], STRENGTH[level]
            back = (s + d * t) / (s + c)
            p = np.where(hit, values[at] if len(values) else 0.0, back * p)
        out += p
    return out / len(samples)


def _sum(n_tokens: int):
    """Rows of a slice: its ids (kind 0) first, then the shards' sums in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches, ("slice", "kind", "blob")):
            ids, size, fold = _unpack(next(b for k, b in rows if k == 0))
            sums = [np.zeros(len(ids), np.int64) for _ in range(3)]
            for k, blob in rows:
                if k:
                    for a, x in zip(sums, _unpack(blob)):
                        a += x
            null = ids == T.NULL_ID
            score = sums[2] * UNIT
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null), pa.array(fold == 0, mask=null), pa.array(size), pa.array(sums[0]), pa.array(np.full(len(ids), n_tokens)), pa.array(sums[1] * UNIT), pa.array(score), pa.array(10 ** (-score / size))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return run


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    with bounded_batches(docs.sparkSession, BATCH):
        n_tokens, answers = _answers(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), burn_in, samples)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return answers.repartition(partitions(docs.sparkSession), "slice").sortWithinPartitions("slice", "kind").mapInArrow(_sum(n_tokens), out)


def _answers(base: DataFrame, burn_in: int, samples: int) -> tuple[int, DataFrame]:
    """Tokens learnt from, and rows for _sum(). All are written here: slices are numbered by Arrow's batches, so the ids
    must not be cut later, when the session's batches may differ."""
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    counted = base.mapInArrow(_count(shards), "shard long, blob binary")
    model = written(_placed(counted, shards, "shard").sortWithinPartitions("shard").mapInArrow(_merge, "shard long, blob binary, n long, v long"), "restaurants")
    n_tokens, vocabulary = model.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    seatings: list[tuple[DataFrame, DataFrame]] = []
    head, heads = None, []
    for number in range(burn_in + samples + 1):  # the first one is before any sweep
        state, reply, head = _swept(model, vocabulary, number, seatings[-1] if seatings else None, head, shards)
        seatings.append((state, reply))
        heads.append(head)
    last = _kinds(model, seatings[burn_in + 1 :])
    answers = written(base.mapInArrow(_ids, "slice long, kind int, blob binary"), "ids")
    for part in range(ROUNDS):
        rows = base.mapInArrow(_ask(shards, part), SCORE).unionByName(last.where(F.col("shard") % ROUNDS == part))
        found = written(_sorted(rows, shards).mapInArrow(_answer(vocabulary, n_tokens, heads[burn_in + 1 :], shards), "slice long, blob binary"), "answers")
        answers = answers.unionByName(found.select("slice", F.lit(1).alias("kind"), "blob"))
    return n_tokens, answers
