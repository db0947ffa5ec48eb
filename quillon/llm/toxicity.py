"""Toxic passages as maximum-scoring segments of token log-odds.

Training. From the labelled rows of the training fold, at most SAMPLE of each class (those with the smallest hash of
their id; the bound is a parameter), tokens are counted by class: the word in lower case without outer punctuation, and its byte
prefixes of PREFIXES, since stems mark inflected or compounded words that are never seen twice. A token's weight is its
log-odds ratio with an informative Dirichlet prior (half a count, and more in proportion to its overall count); those of
MIN_ODDS at least, with a z-score of Z and MIN_DOCS documents of the toxic class, are the lexicon, however many they
are (the sample bounds them). All other words share one weight, the log-odds of their whole mass, so a passage's score
is a log-likelihood ratio. Scoring. A word takes its strongest token; a linear-time scan finds all maximal scoring
segments of a document, skipping words without evidence as whole gaps. The scale comes from
Karlin and Altschul: lambda solves sum p(s) exp(lambda s) = 1 over the word scores of clean training rows, and K is
fitted to their best segments, so a segment's excess is lambda * S - log(K * n). The sum of a document's positive
excesses (Poisson clumping treats separate segments as independent) goes through a logistic curve that is fitted on the
sample with the classes' true weights. Every passage with a positive excess, a significant one, is returned.

Scoring is one narrow pass over all whole texts; the model (a bounded lexicon) goes to the tasks inside the function.
Null and empty texts have no segment: the curve's value at 0. Null ids: the row is scored, its fold is null. Rows whose
label is null are not learnt from; of repeated labels the larger counts. Without labels of both classes every score is
the known class's. Empty tables: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Labelled rows of each class that are learnt from at most.
SAMPLE = 6_000
Z, MIN_DOCS, MIN_ODDS, PRIOR, CAP = 3.5, 4, 1.5, 1000.0, 6.0
#: Lengths in bytes of the prefixes that are tokens beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)
#: Punctuation that is cut from both ends of a word.
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    drift: float
    lam: float
    log_k: float
    slope: float
    bias: float


def trimmed(data: np.ndarray, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Spans without punctuation at either end (an all-punctuation word keeps its first byte)."""
    s, e = w.starts.copy(), w.ends.copy()
    edge = _EDGE[data]
    inner = np.flatnonzero(~edge)
    if len(inner):
        a = np.minimum(np.searchsorted(inner, s), len(inner) - 1)
        first = inner[a]
        last = inner[np.maximum(np.searchsorted(inner, e) - 1, 0)] + 1
        ok = (first >= s) & (first < e)
        s, e = np.where(ok, first, s), np.where(ok, np.maximum(last, first + 1), s + 1)
    else:
        e = s + 1
    return s, e


def token_hashes(s: T.Slice) -> tuple[T.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words, and for the whole words and each prefix length: index of the words that have it, hashes."""
    data = s.data
    w = T.words(data, s.offsets)
    if not len(w.starts):
        return w, []
    a, b = trimmed(data, w)
    out = [(np.arange(len(a)), T.span_hashes(data, a, b))]
    for n in PREFIXES:
        has = np.flatnonzero(b - a > n)
        out.append((has, T.span_hashes(data, a[has], a[has] + n, n)))
    return w, out


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, one past the last, score) of a sequence that has score[i] at word
    at[i] and -drift elsewhere; linear time. Only positions of positive score can begin or end one."""
    stack: list[tuple] = []  # begin, end, sum before, sum after, place of the nearest one before with a lesser sum before
    total, prev = 0.0, -1
    for i, x in zip(at.tolist(), score.tolist()):
        total -= drift * (i - prev - 1)
        prev = i
        if x <= 0:
            total += x
            continue
        begin, left = i, total
        total += x
        j = len(stack) - 1
        while j >= 0 and stack[j][2] >= left:  # what is passed over here is passed over by all that come later
            j = stack[j][4]
        while j >= 0 and stack[j][3] < total:
            begin, _, left, _, link = stack[j]
            del stack[j:]
            j = link
        stack.append((begin, i + 1, left, total, j))
    return [(b, e, r - left) for b, e, left, r, _ in stack]


def scored(s: T.Slice, words: np.ndarray, weights: np.ndarray) -> tuple[T.Words, np.ndarray, np.ndarray]:
    """The words, and index and weight of those with evidence (their strongest token's)."""
    w, tokens = token_hashes(s)
    value = np.zeros(len(w.starts))
    if len(words):
        filled = np.zeros(1 << 20, bool)
        filled[words >> np.uint64(44)] = True
        for at, h in tokens:
            maybe = np.flatnonzero(filled[h >> np.uint64(44)])
            k = np.minimum(np.searchsorted(words, h[maybe]), len(words) - 1)
            hit = words[k] == h[maybe]
            i = at[maybe[hit]]
            value[i] = np.maximum(value[i], weights[k[hit]])
    hit = np.flatnonzero(value > 0)
    return w, hit, value[hit]


def evidence(s: T.Slice, words: np.ndarray, weights: np.ndarray, drift: float) -> Iterator[tuple[int, int, list]]:
    """For each document: its index, words, and maximal scoring segments."""
    w, hit, value = scored(s, words, weights)
    sizes = np.diff(w.first)
    cut = np.searchsorted(hit, w.first)
    for d in range(len(sizes)):
        a, b = cut[d], cut[d + 1]
        yield d, int(sizes[d]), segments(hit[a:b] - w.first[d], value[a:b], drift) if b > a else []


def excess(segs: list, n: int, lam: float, log_k: float) -> float:
    base = log_k + np.log(max(n, 1))
    return float(sum(max(0.0, lam * x - base) for _, _, x in segs))


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """Learns from rows of labels (doc_id, toxic) for which usable holds."""
    spark = docs.sparkSession
    known = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas() for t in (0, 1)]
    labelled = {int(d): t for t, p in enumerate(picked) for d in p["doc_id"]}  # at most 2 * sample ids
    if not all(sizes.get(t) for t in (0, 1)):
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return Model(np.empty(0, np.uint64), np.empty(0), 0.1, 1.0, 0.0, 0.0, 20.0 if share else -20.0)
    chosen = spark.createDataFrame(pd.DataFrame({"id": list(labelled), "toxic": list(labelled.values())}), "id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")).join(F.broadcast(chosen), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", 2 << 20, lower=True):
            w, tokens = token_hashes(s)
            toxic = np.asarray(s.batch.column("toxic"))
            doc = w.doc
            for at, h in tokens:
                order = np.lexsort((doc[at], h))
                h, d = h[order], doc[at][order]
                begin = T.distinct_runs(h, d)
                n = np.diff(np.append(begin, len(h)))
                h, y = h[begin], toxic[d[begin]]
                u = T.distinct_runs(h)
                sums = [np.add.reduceat(x, u) if len(u) else np.empty(0, np.int64) for x in (n * y, n * (1 - y), y.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(h[u])), *map(pa.array, sums)], ["h", "pos", "neg", "docs"])

    counted = rows.mapInArrow(count, "h long, pos long, neg long, docs long").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "docs")))
    # Each word is counted once whole and once for each prefix; rates are by words.
    n_words = rows.mapInArrow(_words_by_class, "pos long, neg long").agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))).first()
    n_pos, n_neg = max(1, n_words[0]), max(1, n_words[1])
    a = (F.col("pos") + F.col("neg")) * F.lit(PRIOR / (n_pos + n_neg)) + 0.5
    pos, neg = F.col("pos") + a, F.col("neg") + a
    delta = F.log(pos / (n_pos + PRIOR - pos)) - F.log(neg / (n_neg + PRIOR - neg))
    strong = counted.where(F.col("docs") >= MIN_DOCS).select("h", delta.alias("d"), (delta / F.sqrt(1 / pos + 1 / neg)).alias("z")).where((F.col("z") >= Z) & (F.col("d") >= MIN_ODDS)).toPandas()
    words = strong["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    words, weights = words[order], np.minimum(strong["d"].to_numpy()[order], CAP)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", 2 << 20, lower=True):
            w, hit, value = scored(s, words, weights)
            cut = np.searchsorted(hit, w.first)
            at = [(hit[a:b] - f).tolist() for a, b, f in zip(cut[:-1], cut[1:], w.first)]
            yield pa.RecordBatch.from_arrays([s.batch.column("id"), pa.array(np.diff(w.first)), pa.array(at, pa.list_(pa.int64())), pa.array([value[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])], pa.list_(pa.float64()))], ["id", "n", "at", "value"])

    seen = rows.mapInArrow(scan, "id long, n long, at array<long>, value array<double>").toPandas()  # 2 * sample rows at most
    y = seen["id"].map(labelled).to_numpy(float)
    n, hits = seen["n"].to_numpy(float), seen["at"].map(len).to_numpy(float)
    rate = [max(0.5, hits[y == t].sum()) / max(1.0, n[y == t].sum()) for t in (0, 1)]
    drift = float(max(1e-3, np.log1p(-min(rate[0], 0.5)) - np.log1p(-min(rate[1], 0.5))))
    seen["segs"] = [[x for _, _, x in segments(np.asarray(a), np.asarray(v), drift)] for a, v in zip(seen["at"], seen["value"])]
    clean = seen[y == 0]
    n_clean = max(1, int(clean["n"].sum()))
    vals = np.concatenate([np.empty(0), *clean["value"]])
    u, c = np.unique(np.round(vals, 1), return_counts=True)
    if not (u > 0).any():  # clean rows never hold evidence: one such word in all of them as the estimate
        u, c = np.append(u, max(1.0, weights.max(initial=1.0) / 2)), np.append(c, 1)
    p = np.append(c / n_clean, max(1e-9, 1 - c.sum() / n_clean))
    u = np.append(u, -drift)
    lo, hi = 1e-4, 8.0
    for _ in range(80):
        lam = (lo + hi) / 2
        lo, hi = (lam, hi) if p @ np.exp(lam * u) < 1 else (lo, lam)
    best = np.array([max(g, default=0.0) for g in clean["segs"]])
    n = np.maximum(1, clean["n"].to_numpy())
    # E[number of segments above S] = K n exp(-lambda S): at the median of the best non-zero scores it is as observed.
    mid = float(np.median(best[best > 0])) if (best > 0).any() else 1.0
    log_k = float(np.log(max(0.5, (best >= mid).sum()) / (n.sum() * np.exp(-lam * mid))))
    x = np.array([excess([(0, 0, v) for v in g], m, lam, log_k) for g, m in zip(seen["segs"], seen["n"])])
    weight = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    return Model(words, weights, drift, lam, log_k, *logistic(np.log1p(x), y, weight))


def _words_by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in T.slices(batches, "id", "text", 2 << 20, lower=True):
        n, y = np.diff(T.words(s.data, s.offsets).first), np.asarray(s.batch.column("toxic"))
        yield pa.RecordBatch.from_arrays([pa.array([int(n[y == 1].sum())]), pa.array([int(n[y == 0].sum())])], ["pos", "neg"])


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted, lightly penalised logistic regression on one feature by Newton steps: slope, bias."""
    a = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    w = w / w.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - np.array([1.0, 0.01]) * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag([1.0, 0.01])
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def probability(model: Model, segs: list, n: int) -> float:
    """Calibrated score of a document of n words with these segments."""
    x = np.log1p(excess(segs, n, model.lam, model.log_k)) if segs else 0.0
    return float(1 / (1 + np.exp(-np.clip(model.slope * x + model.bias, -30, 30))))


PASSAGES = "array<struct<start: long, words: long, score: double, excess: double>>"


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, and the significant passages (first word, words, score, excess) of every row, in order."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("score", pa.float64()), ("excess", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", lower=True):
            score, found = [], []
            for _, n, segs in evidence(s, model.words, model.weights, model.drift):
                score.append(probability(model, segs, n))
                found.append([{"start": b, "words": e - b, "score": x, "excess": y} for b, e, x in segs if (y := excess([(b, e, x)], n, model.lam, model.log_k)) > 0])
            score = np.array(score)
            yield pa.RecordBatch.from_arrays([s.batch.column("id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(found, kind)], ["doc_id", "score", "predicted", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, f"doc_id long, score double, predicted int, passages {PASSAGES}")
