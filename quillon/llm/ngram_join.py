"""Jaccard self-join of word shingle sets, down to connected components, by signature trees.

1. Every document's prefix (its n - ceil(t n) + 1 first shingles in a global order, tokens of a bounded list of frequent
   ones last, then by hash) is written once. Two sets of similarity t share a prefix shingle.
2. Of each prefix shingle and pair of neighbouring size classes the smallest document is the centre; (centre, document) pairs form stars. Both ends of every
   qualifying pair lie in the star of a shingle that they share, so the stars cover the join, and a star, unlike a
   shingle's group, repeats neither pairs nor documents.
3. Stars are cut into chunks of about CHUNK documents and WORDS shingles at most, the centre in each; the members of a
   large star are dealt by (centre, salt), so none of its tables lands in one task. In a chunk a signature tree holds
   OR-combined shingle bitmaps and size ranges; a dual traversal prunes pairs of nodes whose maximum possible overlap is
   too small. It runs twice: over the documents' bitmaps alone, which are a fraction of their texts, to find who has any
   possible partner in the chunk, then over the shingle sets of those, where exact intersection decides pairs of leaves
   and pairs that are connected already are passed over.
4. Components follow. Where a star has several chunks and more than one component, documents outside its largest
   component still meet all its documents, chunk by chunk, through the same traversal; all links are then found.

Equal sets of a slice are linked on the spot and only one of them goes on, so a group of copies of any size costs a few
rows. Edges are spanning forests, never all pairs. No frequency, group or candidate is capped: the bounded list of
frequent shingles only changes the order.

A document is its id: rows that repeat an id, with whatever texts, are one node. Null id: a node below all others, kept
null, component null. Null, empty or blank texts: no shingles, linked with nothing. Empty table: no rows. Extra columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .components import components
from .spark_util import partitions, written

#: Frequent shingles that go last in the order, at most.
FREQUENT = 1 << 16
#: Documents of a star, and shingles of all of them, that meet in one task.
CHUNK, WORDS = 600, 1_000_000
#: Parts that the members of a large star are dealt to.
SALTS = 64
SLICE = 4 << 20
LEAF = 8


def shingle_sets(s: T.Slice, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document."""
    data = T.LOWER[s.data]
    w = T.words(data, s.offsets)
    codes = T.span_hashes(data, w.starts, w.ends)
    all_ = T.window_hashes(codes, k, 23)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(all_[a : b - k + 1]))
        elif b > a:
            out.append(T.sequence_hash(codes[a:b], 29))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Threshold:
    """Jaccard similarity of at least percent / 100, in integers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1 if n else 0

    def overlap(self, a, b):
        """Least intersection of sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def links(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = common(x, y)
        return 100 * both >= self.percent * (len(x) + len(y) - both)


def common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def width(n: int) -> int:
    """Bits of the bitmap of a set of n shingles: the power of two from 4 n, 64 at least."""
    return 1 << max(6, (4 * n - 1).bit_length())


def bitmap(x: np.ndarray, bits: int) -> np.ndarray:
    """Shingles' top bits as a bitmap; one of half as many bits is this one with neighbours OR-combined."""
    flag = np.zeros(bits, np.uint8)
    flag[(x >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = 1
    return np.packbits(flag)


def folded(sig: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of bytes) of half as many bits."""
    flags = np.unpackbits(sig, axis=1)
    return np.packbits(flags[:, ::2] | flags[:, 1::2], axis=1)


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of the shingles that most documents hold, from counts over all documents; at most FREQUENT."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", SLICE):
            u, n = np.unique(np.concatenate(shingle_sets(s, k)), return_counts=True)
            many = n >= max(4, len(s.ids) // 256)
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(u[many])), pa.array(n[many])], ["h", "n"])

    top = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 16").orderBy(F.col("n").desc(), "h").limit(FREQUENT)
    return np.sort(top.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


PREFIX = "id long, doc long, n long, same_as long, tokens array<long>, sig binary"


def _prefixes(k: int, t: Threshold, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", SLICE):
            sets = shingle_sets(s, k)
            least: dict[tuple, int] = {}
            keys = [(len(x), x.tobytes()) if len(x) else None for x in sets]
            for key, doc in zip(keys, s.ids.tolist()):
                if key:
                    least[key] = min(doc, least.get(key, doc))
            sent, tokens, same, sigs = set(), [], [], []
            for key, doc, x in zip(keys, s.ids.tolist(), sets):
                home = least[key] if key else doc
                same.append(home)
                if key is None or doc != home or key in sent:
                    tokens.append([])
                    sigs.append(None)
                    continue
                sent.add(key)
                sigs.append(bitmap(x, width(len(x))).tobytes())
                if len(frequent):
                    last = frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] == x
                    x = np.concatenate([x[~last], x[last]])
                tokens.append(T.signed(x[: t.prefix(len(x))]))
            yield pa.RecordBatch.from_arrays([s.batch.column("id"), pa.array(s.ids), pa.array([len(x) for x in sets], pa.int64()), pa.array(same, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["id", "doc", "n", "same_as", "tokens", "sig"])

    return run


class Forest:
    """Union-find over a chunk's documents that records the edges which joined something."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def known(self, component: np.ndarray) -> None:
        """Documents of one component are connected from the start."""
        _, first, inv = np.unique(component, return_index=True, return_inverse=True)
        self.label = first[inv]

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)
            self.edges.append((i, j))


class SignatureTree:
    """Nodes over documents in order of size: OR-combined bitmaps, size ranges, and the largest surplus of shingles over
    set bits (several shingles of a document may share a bit, so an overlap can exceed the common bits by that much)."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, sig: np.ndarray):
        # Neighbours in (size class, bitmap) tend to be alike, so their nodes stay sparse.
        order = np.lexsort((*sig.view(np.uint64)[:, ::-1].T[-2:], np.floor(np.log(np.maximum(sizes, 1)) / 0.15)))
        self.members, sizes, sig = members[order], sizes[order], np.ascontiguousarray(sig[order]).view(np.uint64)
        # levels[0]: documents; each next level has a node for LEAF nodes below.
        self.levels = [(sig, sizes, sizes, sizes - np.bitwise_count(sig).sum(1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            sig, lo, hi, extra = self.levels[-1]
            at = np.arange(0, len(sig), LEAF)
            self.levels.append((np.bitwise_or.reduceat(sig, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(extra, at)))


def dual_traversal(a: SignatureTree, b: SignatureTree, t: Threshold, todo, visit) -> None:
    """Calls visit(x, y) with arrays of a's and b's documents that may be linked; todo(x, y) masks pairs that are still
    of interest. a and b may be one tree."""
    if not len(a.members) or not len(b.members):
        return
    stack = [(max(len(a.levels), len(b.levels)) - 1, np.array([0]), np.array([0]))]
    while stack:
        level, i, j = stack.pop()
        (sa, la, ha, ea), (sb, lb, hb, eb) = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        if a is b:
            ok = i <= j
            i, j = i[ok], j[ok]
        # Node pairs whose size ranges meet; then the maximum possible overlap.
        ok = (100 * hb[j] >= t.percent * la[i]) & (100 * ha[i] >= t.percent * lb[j]) & (ha[i] > 0) & (hb[j] > 0)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        most = np.minimum(np.bitwise_count(sa[i] & sb[j]).sum(1, dtype=np.int64) + np.minimum(ea[i], eb[j]), np.minimum(ha[i], hb[j]))
        ok = most >= t.overlap(la[i], lb[j])
        i, j = i[ok], j[ok]
        if level == 0:
            if len(i):
                visit(a.members[i], b.members[j])
            continue
        na, nb = (len(x.levels[min(level - 1, len(x.levels) - 1)][0]) for x in (a, b))
        fa, fb = (LEAF if level < len(x.levels) else 1 for x in (a, b))
        for p, q in zip(i.tolist(), j.tolist()):
            ci, cj = np.arange(p * fa, min((p + 1) * fa, na)), np.arange(q * fb, min((q + 1) * fb, nb))
            ci, cj = np.repeat(ci, len(cj)), np.tile(cj, len(ci))
            if level == 1:  # children are documents
                ok = todo(a.members[ci], b.members[cj])
                ci, cj = ci[ok], cj[ok]
            if len(ci):
                stack.append((level - 1, ci, cj))


def with_partners(sizes: np.ndarray, sigs: list[bytes], side: np.ndarray, component: np.ndarray, t: Threshold) -> np.ndarray:
    """Mask of the documents of a block that may be linked to one of another component (and side, if there are sides)."""
    found = np.zeros(len(sizes), bool)
    bits = np.array([8 * len(x) for x in sigs])

    def todo(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (component[x] != component[y]) & ~(found[x] & found[y])

    def visit(x: np.ndarray, y: np.ndarray) -> None:
        found[x] = True
        found[y] = True

    def tree(mask: np.ndarray, fold: bool) -> SignatureTree:
        at = np.flatnonzero(mask)
        sig = np.frombuffer(b"".join(sigs[i] for i in at), np.uint8).reshape(len(at), -1)
        return SignatureTree(at, sizes[at], folded(sig) if fold else sig)

    for b in np.unique(bits).tolist():
        # Sizes of linked sets differ by less than a factor of 2, so their bitmaps' widths by one step at most.
        if (side == 2).all():
            own = tree(bits == b, False)
            dual_traversal(own, own, t, todo, visit)
            if (bits == 2 * b).any():
                dual_traversal(own, tree(bits == 2 * b, True), t, todo, visit)
        else:
            for x, y, fx, fy in ((b, b, False, False), (b, 2 * b, False, True), (2 * b, b, True, False)):
                left, right = (side == 0) & (bits == x), (side == 1) & (bits == y)
                if left.any() and right.any():
                    dual_traversal(tree(left, fx), tree(right, fy), t, todo, visit)
    return found


def tree_edges(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, t: Threshold, forest: Forest) -> None:
    """Joins all linked pairs of left and right documents in forest; left and right may be one array."""
    bits = min(1 << 16, width(max(map(len, sets), default=1)))
    sizes = np.array([len(x) for x in sets])
    make = lambda at: SignatureTree(at, sizes[at], np.stack([bitmap(sets[i], bits) for i in at]))
    if not len(left) or not len(right):
        return
    a = make(left)
    b = a if right is left else make(right)

    def todo(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return forest.label[x] != forest.label[y]

    def visit(x: np.ndarray, y: np.ndarray) -> None:
        for i, j in zip(x.tolist(), y.tolist()):
            if forest.label[i] != forest.label[j] and t.links(sets[i], sets[j]):
                forest.join(i, j)

    dual_traversal(a, b, t, todo, visit)


def _candidates(t: Threshold):
    """Rows sorted by block (c, p, q, side, doc, component, n, sig): those with a possible partner in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def solve() -> list[tuple]:
            if len(rows) < 2:
                return []
            side, _, component, n, sigs = zip(*rows)
            ok = with_partners(np.array(n), list(sigs), np.array(side), np.array(component), t)
            return [(*key, *r[:3]) for r, x in zip(rows, ok) if x]

        for b in batches:
            out = []
            for c, p, q, *row in zip(*(b.column(i).to_pylist() for i in range(8))):
                if (c, p, q) != key:
                    out += solve()
                    key, rows = (c, p, q), []
                rows.append(tuple(row))
            if out:
                yield _block_rows(out)
        if out := solve():
            yield _block_rows(out)

    return run


BLOCK = "c long, p int, q int, side int, doc long, component long"


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["c", "p", "q", "side", "doc", "component"])


def _blocks(k: int, t: Threshold):
    """Rows sorted by block: (block..., side, doc, component, text); side 0: left, 1: right, 2: both (a self-join)."""

    def solve(rows: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
        ids = np.array([r[1] for r in rows], np.int64)
        side = np.array([r[0] for r in rows])
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r[3] for r in rows], pa.string())], ["id", "text"])
        sets = [x for s in T.slices([batch], "id", "text", SLICE) for x in shingle_sets(s, k)]
        forest = Forest(len(ids))
        forest.known(np.array([r[2] for r in rows]))
        if (side == 2).all():
            order = np.argsort(ids, kind="stable")
            tree_edges(sets, order[:1], order[1:], t, forest)  # the centre first: most are linked to it
            tree_edges(sets, order, order, t, forest)
        else:
            tree_edges(sets, np.flatnonzero(side == 0), np.flatnonzero(side == 1), t, forest)
        return [(int(ids[i]), int(ids[j])) for i, j in forest.edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            out = []
            for c, p, q, *row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if (c, p, q) != key:
                    if len(rows) > 1:
                        out += solve(rows)
                    key, rows = (c, p, q), []
                rows.append(tuple(row))
            if out:
                yield _edges(out)
        if len(rows) > 1:
            yield _edges(solve(rows))

    return run


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _solved(blocks: DataFrame, info: DataFrame, base: DataFrame, k: int, t: Threshold) -> DataFrame:
    """Links of blocks (see BLOCK): prunes them by bitmaps, then joins the texts of the rest and decides."""
    p = partitions(base.sparkSession)
    block = ["c", "p", "q", "side", "doc", "component"]
    sigs = info.where("sig is not null").select("doc", "n", "sig")
    small = blocks.join(sigs, "doc").select(*block, "n", "sig")
    rest = small.repartition(p, "c", "p", "q").sortWithinPartitions("c", "p", "q", "doc").mapInArrow(_candidates(t), BLOCK)
    texts = base.select(F.coalesce("id", F.lit(T.NULL_ID)).alias("doc"), "text")
    rows = rest.join(texts, "doc").select(*block, "text")
    return rows.repartition(p, "c", "p", "q").sortWithinPartitions("c", "p", "q", "doc").mapInArrow(_blocks(k, t), "u long, v long")


def _salt():
    return F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")


def _number(n: str):
    return F.pmod(F.xxhash64("doc", F.lit(1)), F.col(n)).cast("int")


def _each(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _salted(stars: DataFrame) -> DataFrame:
    """Stars (c, ...) with a row for each salt of their members."""
    return stars.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _chunks(docs, words):
    return F.greatest(F.ceil(docs / CHUNK), F.ceil(words / WORDS), F.lit(1)).cast("int")


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    t = Threshold(percent)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    info = written(base.mapInArrow(_prefixes(k, t, frequent_shingles(base, k)), PREFIX), "prefixes")
    # Sizes of linked sets lie in one size class or in neighbouring ones: a group has a shingle and two classes.
    size_class = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100 - 0.001)).cast("int")
    token = info.select("doc", "n", size_class.alias("k"), F.explode("tokens").alias("token")).select("doc", "n", F.explode(F.array(F.xxhash64("token", "k"), F.xxhash64("token", F.col("k") + 1))).alias("token"))
    centres = token.groupBy("token").agg(F.min("doc").alias("c"), F.max("doc").alias("top")).where("c <> top").select("token", "c")
    stars = written(token.join(centres, "token").where("doc <> c").groupBy("c", "doc").agg(F.max("n").alias("n")), "pairs")
    size = stars.groupBy("c").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words"))
    large = _salted(size.where((F.col("docs") > CHUNK // 2) | (F.col("words") > WORDS // 2)).select("c", F.lit(True).alias("large")))
    stars = stars.withColumn("s", _salt()).join(large, ["c", "s"], "left")
    stars = written(stars.select("c", F.when(F.col("large"), F.col("s")).otherwise(0).alias("s"), F.coalesce("large", F.lit(False)).alias("large"), "doc", "n"), "stars")

    # Each document in its smallest centre's star; the centre goes to each chunk.
    nearest = stars.groupBy("doc").agg(F.min("c").alias("c"), F.max("n").alias("n"))
    sizes = nearest.groupBy("c").agg(_chunks(F.count(F.lit(1)), F.sum("n")).alias("chunks"))
    members = nearest.withColumn("s", _salt()).join(_salted(sizes.where("chunks > 1")), ["c", "s"], "left").select("c", F.coalesce(_number("chunks"), F.lit(0)).alias("p"), "doc")
    blocks = members.unionByName(sizes.select("c", _each("chunks").alias("p"), F.col("c").alias("doc")))
    first = _solved(blocks.select("c", "p", F.lit(0).alias("q"), F.lit(2).alias("side"), "doc", F.col("doc").alias("component")), info, base, k, t)
    links = written(first.unionByName(info.where("doc <> same_as").select(F.col("doc").alias("u"), F.col("same_as").alias("v"))), "links")
    found = components(links)

    # All stars that hold more than one component, for the pairs across components.
    whole = stars.unionByName(stars.groupBy("c").agg(F.max("large").alias("large")).select("c", F.lit(0).alias("s"), "large", F.col("c").alias("doc"), F.lit(0).cast("long").alias("n")))
    whole = whole.join(found, whole.doc == found.node, "left").select("c", "s", "large", "doc", "n", F.coalesce("component", "doc").alias("component"))
    counts = whole.groupBy("c", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("words"), F.max("large").alias("large"))
    mixed = counts.groupBy("c").agg(F.max_by("component", "m").alias("main"), F.max("m").alias("m"), F.sum("m").alias("docs"), F.sum("words").alias("words"), F.max("large").alias("large")).where("m < docs")
    mixed = mixed.select("c", "main", "large", _chunks(F.col("docs") - F.col("m"), F.col("words")).alias("left"), _chunks(F.col("docs"), F.col("words")).alias("right"))
    mixed = mixed.withColumn("s", F.explode(F.sequence(F.lit(0), F.when(F.col("large"), SALTS - 1).otherwise(0)))).drop("large")
    wide = written(whole.join(mixed, ["c", "s"]), "mixed")
    if not wide.isEmpty():
        one = wide.where("right = 1").select("c", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(2).alias("side"), "doc", "component")
        many = wide.where("right > 1")
        outside = many.where("component <> main").select("c", _number("left").alias("p"), _each("right").alias("q"), F.lit(0).alias("side"), "doc", "component")
        everyone = many.select("c", _each("left").alias("p"), _number("right").alias("q"), F.lit(1).alias("side"), "doc", "component")
        more = written(_solved(one.unionByName(outside).unionByName(everyone), info, base, k, t), "more")
        if not more.isEmpty():
            found = components(links.unionByName(more))

    out = info.select("id", "doc", "n")
    null = lambda c: F.when(F.col("id").isNotNull(), F.nullif(c, F.lit(T.NULL_ID)))
    return out.join(found, out.doc == found.node, "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), null(F.coalesce("component", "doc")).alias("component_id"))
