"""Operators against brute force, exact round trips and held-out accuracy, with null, empty, repeated and hot rows."""

import collections
import hashlib
import math
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import decontaminate, filters, flac, packing, queries, warc
from quillon.llm import pitman_yor as hpy
from quillon.llm import toxicity as tox
from quillon.llm.components import components
from quillon.llm.line_dedup import line_dedup
from quillon.llm.ngram_join import ngram_components
from quillon.llm.substring_dedup import substring_dedup
from quillon.llm.token_counts import token_counts

DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COMMON = " ".join(f"w{i}" for i in range(30))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, COMMON), (4, COMMON), (None, COMMON), (5, "x " + COMMON + " y"), (6, "a" * 3000), (7, "one long line that repeats\nZ"), (8, "One long line that REPEATS \nq"), (9, "one long line that repeats"), (10, "é日本 <|endoftext|> it's"), *((100 + i, COMMON + f" tail{i}") for i in range(40))]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "k", "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, th string, keep string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark):
    con = duckdb.connect()
    for n in ("documents", "pages"):
        con.execute(f"create view {n} as select * from '{DIR}/{n}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DIR).toPandas()[list(want.columns)]
    rows = lambda d: sorted(map(tuple, d.astype(object).where(d.notna(), None).values.tolist()), key=str)
    assert rows(got) == rows(want)


def test_substring_dedup_odd_rows(odd):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(odd).collect())
    # The null id is below all others: its copy stays, all others lose the passage.
    assert got[(None, 30, 0)] == 1 and got[(4, 30, 30)] == 2 and got[(5, 32, 30)] == 1 and got[(1, 0, 0)] == 1 and got[(139, 31, 30)] == 1
    assert sum(got.values()) == len(ODD)


def test_line_dedup_odd_rows(odd):
    got = {r.doc_id: r for r in line_dedup(odd).collect()}
    assert got[7].n_dropped == got[8].n_dropped == 1 and got[9].n_dropped == 0
    assert got[7].kept_sha256 == hashlib.sha256(b"Z").hexdigest() and got[1].n_lines == 1


def test_ngram_components_brute_force(spark, odd):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_components(odd, 4, 85).collect()}
    assert got[(1, 0)] == 1 and got[(None, 27)] is None and got[(6, 1)] == 6
    # The null id is below all others, so its copies' component has no id of its own: it stays null.
    want = {(i, 28): got[(139, 28)] for i in range(100, 140)}
    assert all(got[k] == v for k, v in want.items()) and got[(4, 27)] == got[(139, 28)]


def test_ngram_chunks_lose_no_link(spark, monkeypatch):
    from quillon.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(60):
        t = list(base)
        for p in rng.integers(0, 60, int(rng.integers(0, 4))):
            t[p] = f"z{rng.integers(0, 5)}"
        rows.append((i, " ".join(t)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(57)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == label


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100, 103: 100}


def test_token_counts_and_packing(spark, odd):
    tok = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()] + [(10**6 + i, t) for i, (_, t) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()} == {i: len(x) for i, x in ids.items()}
    got = packing.pack(docs, PATH).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(x) + 1 for i, x in ids.items()}
    for r in got.itertuples():
        raw = np.array(ids[r.doc_id] + [1], "<u4")
        assert r.doc_tokens == len(raw) and zlib.crc32(raw[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048


def test_fill_is_closest():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 60, 8).tolist()
        used = packing.fill(collections.Counter(lengths), 100)
        first = max(lengths)
        rest = list(lengths)
        rest.remove(first)
        sums = {0}
        for n in rest:
            sums |= {s + n for s in sums}
        assert sum(n * k for n, k in used.items()) == first + max(s for s in sums if s <= 100 - first)


def test_flac_round_trip():
    rng = np.random.default_rng(0)
    texts = [b"", b"a" * 5000, bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), b"\x00\xff" * 3000, bytes((np.sin(np.arange(6000) / 20) * 100 + 128).astype(np.uint8)), "é日本 text".encode() * 99]
    payloads = [flac.padded(t) for t in texts]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    bad = bytearray(streams[4])
    bad[-10] ^= 1
    with pytest.raises(flac.Corrupt):
        flac.decode([bytes(bad)])


def test_warc_audit(spark):
    rows = [(i, "u", f"body {i}") for i in range(1000)] + [(5, "u", "again")]
    a = spark.createDataFrame(rows, "page_id long, url string, html string")
    b = a.where("page_id <> 700").withColumn("html", F.when(F.col("page_id") == 3, "other").otherwise(F.col("html")))
    assert {(r.page_id, r.fault) for r in warc.audit(warc.records(a), warc.records(b)).collect()} == {(700, "missing"), (3, "changed")}
    odd = warc.leaves(warc.records(spark.createDataFrame([(None, None, None), (5, "u", "x"), (5, "u", "x")], a.schema)))
    assert {(r.position, r.n) for r in odd.collect()} == {(None, 1), (5, 2)}
    none = a.where("false")
    assert warc.audit(warc.records(none), warc.records(none)).count() == 0


def test_decontamination(spark, odd):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "pre " + item.upper() + ", post"), (2, "clean " * 30), (3, item.replace("q19", "z")), (4, item.replace("q9", "z")), (5, "tiny one"), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "tiny one"), (9, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 7), (3, 7), (5, 8)}


def best_similarities(docs, items, k=5):
    """(document, item) -> similarity of the best window, for distinct lower-case words without punctuation."""
    shingles = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    sets = {i: collections.Counter(shingles(t.split())) for i, t in items}
    df = collections.Counter(s for c in sets.values() for s in c)
    weigh = lambda c: sum(n * math.log1p(len(items) / max(1, df[s])) for s, n in c.items())
    best = {}
    for d, text in docs:
        w = text.split()
        for i, t in items:
            size = min(len(t.split()), len(w))
            wins = [collections.Counter(shingles(w[a : a + size])) for a in range(len(w) - size + 1)]
            best[d, i] = max(weigh(x & sets[i]) / weigh(x | sets[i]) for x in wins)
    return best


def test_decontamination_finds_items_with_a_shared_template(spark):
    """Unshared shingles are rare and shared ones common, so weights differ most."""
    template = " ".join(f"t{i}" for i in range(70))
    items = [(i, f"{template} own{i}") for i in range(200)]
    docs = [(i, f"{template} else{i}") for i in range(5)]
    want = {k for k, s in best_similarities(docs, items).items() if s >= 0.8}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) == 1000 and len(got) >= 995


def test_decontamination_weighs_over_the_whole_benchmark(spark, monkeypatch):
    """The result does not depend on how the items fall into blocks; the last block has one item."""
    template = " ".join(f"t{i}" for i in range(64))
    items = [(i, f"{template} {' '.join(f'own{i}x{j}' for j in range(7))}") for i in range(21)]
    docs = [(1, f"{template} {' '.join(f'else{j}' for j in range(7))}"), (2, items[20][1]), (3, items[3][1])]
    want = {k: s for k, s in best_similarities(docs, items).items() if s >= 0.8}
    assert set(want) == {(2, 20), (3, 3)}
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (5000, 5):
        monkeypatch.setattr(decontaminate, "ITEMS", size)
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(*tables).collect()}
        assert got == pytest.approx(want)
        assert [r.doc_id for r in filters.without_benchmark(*tables).collect()] == [1]


def test_language_model(spark):
    rows = [(i, f"the cat number {i % 7} sat on the mat {'again ' * (i % 3)}") for i in range(300)] + [(1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = hpy.language_model_scores(docs).toPandas().set_index("doc_id")
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    toks = {i: [*words((t or "").translate(LOWER)), None] for i, t in rows}
    c = collections.Counter(w for i, x in toks.items() if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in toks.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(x), sum(c[w] > 0 for w in x), n, held(i))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x))
    h = got[got.held_out]
    assert h.score.sum() > h.base_score.sum()


def _totals(x, discount=(0.6, 0.5, 0.4)):
    return hpy.Totals([(level, int(p), int(c), int(t)) for level, at, cs, ts in x.totals() for p, c, t in zip(at, cs, ts)], discount).with_leaves(x.contexts, *x.leaves())


def test_predictive_sums_to_one(spark):
    """In every restaurant the probabilities of all known words and the unknown one sum to 1."""
    docs = spark.createDataFrame([(i, f"a b{i % 5} c a b{i % 3}") for i in range(60)], "id long, text string").coalesce(1)
    row = docs.mapInArrow(hpy._count(1), "shard long, blob binary").mapInArrow(hpy._merge, "shard long, blob binary, n long, v long").first()
    x = hpy.Shard(0, row["blob"], row["v"])
    for number in range(2):
        totals = _totals(x)
        for ctx in np.unique(x.place[0])[:3].tolist() + [65535]:
            w = np.append(np.arange(len(x.words)), -1)
            p = hpy.predictive(w, np.full(len(w), ctx), x.key[:2], [(x.probabilities(totals), totals)], row["v"])
            assert p.sum() == pytest.approx(1)
        x.sweep(number, totals)


def test_seats_follow_one_by_one_seating():
    """Parties of several sizes, seated in growing steps, have the tables of customers who are seated one by one."""
    rng = np.random.default_rng(0)
    for c, new, more, d in ((2, 0.5, 0.1, 0.5), (40, 2.0, 0.3, 0.7), (3000, 5.0, 0.2, 0.6)):
        n = 400
        got = hpy.seat(np.full(n, c), np.full(n, new), np.full(n, more), d, rng.integers(0, 2**63, n).astype(np.uint64))
        t = np.ones(n)
        for seated in range(1, c):
            w = new + more * t
            t += rng.random(n) < w / (w + seated - d * t)
        assert got.min() >= 1 and got.max() <= c and got.mean() == pytest.approx(t.mean(), rel=0.06)


def test_language_model_scores_by_hand(spark):
    """Scores of held-out and learnt documents against a plain version that keeps restaurants in dictionaries."""
    rows = [(i, f"red {'fox' if i % 3 else 'hen'} runs {'far ' * (i % 4)}away") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in hpy.language_model_scores(docs, burn_in=0, samples=1).collect()}
    model = docs.withColumnRenamed("doc_id", "id").mapInArrow(hpy._count(1), "shard long, blob binary").mapInArrow(hpy._merge, "shard long, blob binary, n long, v long").first()
    x, v = hpy.Shard(0, model["blob"], model["v"]), model["v"]
    counts = [[int((c == n).sum()) for n in (1, 2)] for c in x.c]
    discount = tuple(min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5 for a, b in counts)
    x.sweep(1, _totals(x, discount))
    leaf = {(int(w), int(c)): (int(n), int(t)) for w, c, n, t in zip(x.key[0][1] >> 32, x.place[0], x.c[0], x.t[0])}
    mid = {(int(k >> hpy.FAMILY_BITS), int(f)): (int(n), int(t)) for k, f, n, t in zip(x.key[1], x.place[1], x.c[1], x.t[1])}
    top = {(w, 0): (int(n), int(t)) for w, (n, t) in enumerate(zip(x.c[2], x.t[2]))}

    def p(level, w, ctx):
        if level == 3:
            return 1 / (v + 1)
        table, at = (leaf, mid, top)[level], (ctx, ctx >> 58, 0)[level]
        own = table.get((w, at), (0, 0))
        every = [x for (_, r), x in table.items() if r == at]
        d, s = discount[level], hpy.STRENGTH[level]
        return (own[0] - d * own[1] + (s + d * sum(t for _, t in every)) * p(level + 1, w, ctx)) / (s + sum(n for n, _ in every))

    for i, text in rows:
        s = next(hpy.T.slices([hpy.pa.record_batch({"id": [i], "text": [text]})], "id", "text"))
        k = hpy.Tokens(s)
        words = [int(np.searchsorted(x.words, k.words[w])) for w in k.word]
        assert got[i] == pytest.approx(sum(math.log10(p(0, w, int(k.contexts[c]))) for w, c in zip(words, k.ctx)), abs=1e-6)


def test_language_model_ignores_partitions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts, size in (("4", 10 << 20), ("10", 1 << 15)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        hpy.SHARD_BYTES, old = size, hpy.SHARD_BYTES
        try:
            found.append(sorted(tuple(r) for r in hpy.language_model_scores(docs.repartition(int(parts))).collect()))
        finally:
            hpy.SHARD_BYTES = old
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_language_model_has_a_partition_for_each_shard(spark):
    rows = spark.range(0, 600, 1, 3).select((F.col("id") % 30).alias("shard"), F.lit(0).alias("kind"), F.col("id").alias("slice"))
    found = hpy._sorted(rows, 30).select("shard", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().collect()
    assert len(found) == 30 and {r["count"] for r in found} == {1}


def test_language_model_reads_bounded_batches(spark, monkeypatch):
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word', id % 7, ' '), 10000)").alias("text"))
    seen, count = [], hpy._count

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def spied(shards):
        seen.append(max(r["n"] for r in docs.select("text").mapInArrow(size, "n long").collect()))
        return count(shards)

    monkeypatch.setattr(hpy, "_count", spied)
    scores = hpy.language_model_scores(docs)
    assert 1 << 20 < seen[0] <= hpy.SLICE
    # Batches of another size when the scores are read don't mix up slices.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    try:
        spark.conf.set(key, "7")
        assert sorted(r["doc_id"] for r in scores.collect()) == list(range(300))
    finally:
        spark.conf.set(key, before)


def test_each_word_is_a_context(spark):
    """Unlike preceding words share no restaurant, and customers of all restaurants are counted."""
    rows = [(i, " ".join(f"w{i}x{j} {'the' if j % 2 else 'a'}" for j in range(100))) for i in range(100)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    c = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            c.update([None, *t.split()])
    row = docs.mapInArrow(hpy._count(1), "shard long, blob binary").mapInArrow(hpy._merge, "shard long, blob binary, n long, v long").first()
    x = hpy.Shard(0, row["blob"], row["v"])
    assert sorted(n for n in x.leaves()[0].tolist() if n) == sorted(c.values())


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    g = got[got.held_out]
    tp, fp, fn = (((g.predicted == p) & (g.toxic == t)).sum() for p, t in ((1, 1), (1, 0), (0, 1)))
    assert tp / (tp + fn) > 0.9 and tp / (tp + fp) > 0.9


def test_segments_brute_force():
    """All maximal scoring segments, by their definition: the best one, then those of what is left and right of it."""
    rng = np.random.default_rng(0)

    def split(full, lo, hi):
        best = max(((full[i:j].sum(), i - j, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        return [*split(full, lo, best[2]), best[2:], *split(full, best[3], hi)] if best[0] > 1e-9 else []

    for _ in range(60):
        n = int(rng.integers(1, 12))
        at = np.sort(rng.choice(24, n, replace=False))
        x = rng.random(n) * 4 + 0.1
        full = np.full(24, -1.0)
        full[at] = x
        assert [(b, e) for b, e, _ in tox.segments(at, x, 1.0)] == split(full, 0, 24)


def test_segments_are_linear():
    began = time.time()
    assert len(tox.segments(np.arange(1_000_000) * 9, np.ones(1_000_000), 0.5)) == 1_000_000
    assert len(tox.segments(np.arange(1_000_000) * 2, np.ones(1_000_000), 0.5)) == 1
    assert time.time() - began < 10


def thue_morse(n):
    """Two unlike texts that polynomial hashes modulo powers of two can't tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return ["".join("ab"[b ^ x] for b in bits) for x in (0, 1)]


@pytest.mark.parametrize("n", [1024, 2048])
def test_unlike_texts_are_told_apart(spark, n):
    a, b = thue_morse(n)
    docs = spark.createDataFrame([(1, a), (2, a), (3, b)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup(docs).collect()} == {0}
    assert {r.doc_id: r.component_id for r in ngram_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    tail = " ".join(f"t{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {1: 0, 2: 25}


def test_repeats_are_verified_by_their_source(spark, monkeypatch):
    """With hashes that always collide nothing but what the source's words confirm is removed."""
    from quillon.llm import substring_dedup as sd

    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(30))) for i in range(3)], "doc_id long, text string")
    found = sd.repeats(docs)
    assert found.count() == 0
    span = np.array([(0, 5, 0, 0, 0)], sd.RUN)
    th = {r.doc: r.th for r in sd.hashed(docs, "doc_id", "text").collect()}
    span["sth"] = th[0]
    false = spark.createDataFrame([(1, th[1], bytearray(span.tobytes()))], "doc long, th long, spans binary")
    monkeypatch.setattr(sd, "repeats", lambda *_: false)
    assert {r.n_removed for r in sd.substring_dedup(docs).collect()} == {0}


def test_texts_are_cut_into_paths_once(spark, monkeypatch):
    """One pass over the texts finds the paths and what their slices settle, and copies that a slice settles are one span each."""
    from quillon.llm import substring_dedup as sd

    text = " ".join(f"w{j}" for j in range(2000))
    periodic = " ".join("abc"[j % 3] for j in range(400))
    texts = [text] * 10 + [f"{text[:4000]} other {text[4000:]}", periodic, periodic, "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, text)], "doc_id long, text string").coalesce(1).localCheckpoint()
    plans, spans, write = [], [], sd.written

    def written(df, name):
        if name != "spans":
            return write(df, name)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        spans.append(write(df, name))
        return spans[-1]

    monkeypatch.setattr(sd, "written", written)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.substring_dedup(docs).collect())
    seen, want = set(), collections.Counter()
    for i, t in enumerate(texts):
        words, gone = (t or "").split(), set()
        for j in range(len(words) - 19):
            w = tuple(words[j : j + 20])
            gone.update(range(j, j + 20) if w in seen else ())
            seen.add(w)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        want[i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 2 if i == 3 else 1
    assert got == want
    assert plans[0].count("MapInArrow") == 2 and "Union" not in plans[0]
    assert spans[0].where(F.col("kind") == sd.REPEAT).where("doc between 1 and 9").count() == 10


def test_rows_that_share_an_id_are_one_document(spark):
    line = "one line that is long enough"
    docs = spark.createDataFrame([(5, line + "\nx"), (5, line + "\ny"), (6, line)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup(docs).collect()} == {0}
    docs = docs.unionByName(spark.createDataFrame([(4, line)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup(docs).collect()) == [(4, 1), (5, 1), (5, 1), (6, 0)]


def test_decontamination_recall(spark):
    """Found pairs against all windows by brute force, at similarities around and above the threshold."""
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(int(rng.integers(30, 90))))) for i in range(40)]
    docs = []
    for d in range(160):
        words = items[d % 40][1].split()
        for at in rng.integers(0, len(words), int(rng.integers(0, 3))):
            words[at] = f"z{d}x{at}"
        docs.append((d, " ".join([f"p{d}x{j}" for j in range(20)] + words + [f"q{d}x{j}" for j in range(20)])))
    want = {k for k, s in best_similarities(docs, items).items() if s >= 0.8}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) > 60 and len(got) >= 0.97 * len(want)


def test_index_finds_all_within_its_radius():
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"{i}w{j}" for j in range(30))) for i in range(300)]
    index = decontaminate.Index(items, 5, 0.8, decontaminate.Weights(np.empty(0, np.uint64), np.empty(0), 300))
    asked = index.prints.copy()
    for i in range(300):
        for bit in rng.choice(64, int(rng.integers(0, 22)), replace=False):
            asked[i] ^= np.uint64(1) << np.uint64(bit)
    at, item, distance = index.near(asked, 30)
    want = {(i, j) for i in range(300) for j in range(300) if int(asked[i] ^ index.prints[j]).bit_count() <= index.radius}
    assert set(zip(at.tolist(), item.tolist())) == want and (distance <= index.radius).all()


def test_odd_rows_of_all_operators(spark, odd):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names."""
    long = spark.createDataFrame([(77, "lorem ipsum dolor " * 200_000, "k", "x")], odd.schema)
    docs = odd.unionByName(long)
    items = spark.createDataFrame([(1, COMMON, "u"), (1, COMMON, "v"), (None, "lorem ipsum dolor", "w"), (3, None, "w")], "item_id long, text string, id string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert (None, 1) in found and (4, 1) in found and (77, None) in found and not any(d in (1, 2, 3) for d, _ in found)
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(100, 140)] + [(4, None, "z"), (None, 1, "z"), (5, 1, "z"), (5, 0, "z")], "doc_id long, toxic int, text string")
    got = tox.toxicity(docs, tox.train(docs, labels, F.lit(True))).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    rows = flac.media_digests(flac.flac_column(docs, "doc_id", "text")).collect()
    texts = [(i, (t or "").encode()) for i, t in ODD] + [(77, b"lorem ipsum dolor " * 200_000)]
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in rows) == collections.Counter((i, len(t), hashlib.sha256(flac.padded(t)).hexdigest()) for i, t in texts)
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == len(COMMON)}) == 1
    assert substring_dedup(docs).where("doc_id = 77").first().n_removed == 600_000 - 3
    assert line_dedup(docs).count() == ngram_components(docs).count() == token_counts(docs, PATH).count() == len(ODD) + 1
    pages = spark.createDataFrame([(1, "u", "x" * 3_000_000, "k"), (2, None, None, "k"), (None, "v", "", "k")], "page_id long, url string, html string, position string")
    assert {(r.page_id, r.fault) for r in warc.audit(warc.records(pages), warc.records(pages.where("page_id = 1"))).collect()} == {(2, "missing"), (None, "missing")}


def test_pcm_blocks_seek(spark):
    docs = spark.createDataFrame([(1, "é words " * 500), (2, "")], "doc_id long, text string")
    rows = flac.pcm_blocks(flac.flac_column(docs, "doc_id", "text")).collect()
    for key, text in ((1, "é words " * 500), (2, "")):
        payload = flac.padded(text.encode())
        mine = sorted((r for r in rows if r.id == key), key=lambda r: r.first_sample)
        assert [r.first_sample for r in mine] == [r.block * flac.BLOCK for r in mine] and sum(r.n_samples for r in mine) == len(payload)
        for r in mine:
            assert bytes(x ^ 0x80 for x in r.pcm) == payload[r.first_sample : r.first_sample + r.n_samples]


def flac_by_hand(samples, bits, parts, channels=1, mid_side=False):
    """A one-frame stream with an order-1 fixed predictor, several Rice partitions and an escaped first one."""
    word, size = 0, 0

    def put(v, w):
        nonlocal word, size
        word, size = word << w | v & ((1 << w) - 1), size + w

    n = len(samples[0])
    lanes = samples
    if mid_side:
        lanes = [[(a + b) >> 1 for a, b in zip(*samples)], [a - b for a, b in zip(*samples)]]
    code = {8: 1, 16: 4}[bits]
    head = bytes([0xFF, 0xF8, 0x70, (10 if mid_side else channels - 1) << 4 | code << 1, 0]) + (n - 1).to_bytes(2, "big")
    for lane, x in enumerate(lanes):
        wide = bits + (mid_side and lane == 1)
        put(0x12, 8)  # fixed predictor of order 1
        put(x[0], wide)
        put(0, 2)
        put(parts, 4)
        res = [b - a for a, b in zip(x, x[1:])]
        step = n >> parts
        for j in range(1 << parts):
            part = res[max(0, j * step - 1) : (j + 1) * step - 1]
            if j == 0:
                put(15, 4)
                put(18, 5)
                for r in part:
                    put(r, 18)
            else:
                put(j, 4)
                for r in part:
                    u = r << 1 if r >= 0 else -r * 2 - 1
                    put(1, (u >> j) + 1)
                    put(u, j)
    put(0, -size % 8)
    body = head + bytes([flac.crc8(head)]) + word.to_bytes(size // 8, "big")
    body += int(flac.crc16(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0]).to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + body


def test_flac_of_other_encoders():
    rng = np.random.default_rng(2)
    x = rng.integers(-100, 100, 64).tolist()
    assert flac.decode([flac_by_hand([x], 8, 2)]) == [bytes(v + 128 for v in x)]
    left, right = (rng.integers(-30000, 30000, 64).tolist() for _ in range(2))
    for side in (False, True):
        form, pcm = flac.read_pcm(flac_by_hand([left, right], 16, 3, 2, side))
        assert form == (8000, 2, 16) and pcm.T.tolist() == [left, right]


def test_empty_tables(spark, empty):
    assert substring_dedup(empty).count() == line_dedup(empty).count() == ngram_components(empty).count() == 0
    assert token_counts(empty, PATH).count() == packing.pack(empty, PATH).count() == hpy.language_model_scores(empty).count() == 0
    assert decontaminate.contaminated(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    model = tox.train(empty, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert tox.toxicity(empty, model).count() == 0
    assert flac.media_digests(flac.flac_column(empty, "doc_id", "text")).count() == 0


def brute_pipeline(docs, items, model, tok):
    """The five stages in plain Python over (id, text) rows; toxicity takes the trained lexicon and curve."""
    def score(text):
        w = [x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or x[:1] for x in words((text or "").lower())]
        hash_ = lambda b, n=0: int(hpy.T.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), n)[0])
        known = dict(zip(model.words.tolist(), model.weights.tolist()))
        value = [max([known.get(hash_(b), 0.0)] + [known.get(hash_(b[:n], n), 0.0) for n in tox.PREFIXES if len(b) > n]) for b in (x.encode() for x in w)]
        hit = [i for i, v in enumerate(value) if v > 0]
        return tox.probability(model, tox.segments(np.array(hit, int), np.array([value[i] for i in hit]), model.drift), len(w))

    docs = [(i, t) for i, t in docs if score(t) < 0.3]
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    held = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    gone = lambda i, x: len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != i
    docs = [(i, "\n".join(x for x in t.split("\n") if not gone(i, x)) if t else t) for i, t in docs]
    sets = {}
    for i, t in docs:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    docs = [(i, t) for i, t in docs if label[i] == i]
    plain = lambda t: " ".join(x.strip(".,;:!?\"'()") or x[:1] for x in words((t or "").lower()))
    best = best_similarities([(i, plain(t)) for i, t in docs if len(plain(t).split()) >= 5], [(i, plain(t)) for i, t in items])
    leaks = {d for (d, _), s in best.items() if s >= 0.8}
    return {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs if i not in leaks}


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(8)
    text = lambda i, n: " ".join(f"v{rng.integers(0, 400)}" for _ in range(n)) + f" own{i}"
    bad = [f"vile{k}" for k in range(6)]
    rows, toxic = [], {}
    for i in range(120):
        t = text(i, int(rng.integers(20, 60)))
        if i % 4 == 0:
            w = t.split()
            for p in rng.integers(0, len(w), 8):
                w[p] = bad[int(rng.integers(0, 6))]
            t = " ".join(w)
        toxic[i] = int(i % 4 == 0)
        rows.append((i, t))
    line = "a line that many documents hold, word for word"
    rows += [(200 + i, f"{text(200 + i, 15)}\n{line.upper() if i % 2 else line}\n{text(i, 9)}") for i in range(5)]
    rows += [(300 + i, rows[1][1] + (" tail" if i else "")) for i in range(3)] + [(300, rows[1][1])]
    items = [(k, " ".join(f"b{k}x{j}" for j in range(30))) for k in range(4)]
    rows += [(400, f"{text(1, 10)} {items[2][1].upper()}, {text(2, 10)}"), (401, items[0][1]), (402, text(3, 12) + " " + " ".join(items[1][1].split()[:12])), (500, None), (501, ""), (502, "word")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    usable = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = tox.train(docs.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet"), usable)
    want = brute_pipeline(rows, items, model, Tokenizer.from_file(PATH))
    assert len({i for i, _ in rows}) - len(want) > 25 and not {400, 401, 302} & set(want) and {1, 204, 402, 500, 501} <= set(want)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    pieces = got.groupby("doc_id").length.sum().to_dict()
    assert pieces == {i: len(x) for i, x in want.items()}
    for r in got.itertuples():
        raw = np.array(want[r.doc_id], "<u4")
        assert zlib.crc32(raw[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(raw)


def test_pipeline_reads_bounded_batches(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word', id % 7, ' '), 10000)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(60000).cast("long").alias("n_chars"))

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        after = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, DIR)
        # The stage's rows are read after it has returned.
        assert 1 << 20 < max(r["n"] for r in docs.select("text").mapInArrow(size, "n long").collect()) <= 4 << 20
        kept = after.select("doc_id", F.length("text").alias("n")).collect()
        assert sorted(r["doc_id"] for r in kept) == list(range(300))
        assert sorted(r["doc_id"] for r in kept if r["n"]) == list(range(293, 300))
    finally:
        if before is not None:
            spark.conf.set(key, before)
        else:
            spark.conf.unset(key)


def test_pipeline_takes_effect(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, DIR)
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in kept.select("doc_id").collect()}
        kept = after
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, kept, DIR).select("doc_id").collect()} == ids
