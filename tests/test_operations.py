"""The registered operators against DuckDB, and small cases of those that SQL can't express."""

import pytest
from test_queries import DIR, duck, plain  # noqa: F401

from quillon.plans.operations import OPERATIONS


@pytest.mark.parametrize("name", sorted(OPERATIONS))
def test_operation(name, spark, duck):  # noqa: F811
    query, sql = OPERATIONS[name]
    df = query(spark, DIR)
    if sql is None:  # tested below
        assert df.columns and df.count() > 0
        return
    want = duck.execute(sql)
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    got = sorted(([plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    assert got == sorted(([plain(v) for v in r] for r in want.fetchall()), key=str)


def test_neighbourhood_whole_reaches_all_orders(spark):
    rows = spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    parts = {p for o, p in rows if o == 1}
    want = {o for o, p in rows if p in parts and o != 1}
    got = {r.key for r in OPERATIONS["neighbourhood"][0](spark, DIR).where("distance = 2").collect()}
    assert got == want and max(got) >= 200


def plain_script(a, b):
    """The shortest edit script by dynamic programming over the furthest points, removals first on ties."""
    v, trace = {1: 0}, []
    for d in range(len(a) + len(b) + 1):
        trace.append(dict(v))
        for k in range(-d, d + 1, 2):
            x = v[k + 1] if k == -d or (k != d and v[k - 1] < v[k + 1]) else v[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            v[k] = x
            if x >= len(a) and x - k >= len(b):
                out, x, y = [], len(a), len(b)
                for e in range(d, 0, -1):
                    w, q = trace[e], x - y
                    down = q == -e or (q != e and w[q - 1] < w[q + 1])
                    px = w[q + 1] if down else w[q - 1]
                    py = px - (q + 1 if down else q - 1)
                    while x > px + (not down) and y > py + down:
                        x, y = x - 1, y - 1
                        out.append(" " + a[x])
                    if down:
                        y -= 1
                        out.append("+" + b[y])
                    else:
                        x -= 1
                        out.append("-" + a[x])
                while x:
                    x -= 1
                    out.append(" " + a[x])
                return out[::-1]


def test_edit_script_is_canonical():
    import random

    from quillon.operators.history import edit_script

    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert [c + (b[j] if c == "+" else a[i]) for c, i, j in edit_script(a, b)] == plain_script(a, b)


def test_unified_diff_applies(spark):
    """Every registered diff turns the first version into the last."""
    import re

    rows = spark.read.parquet(f"{DIR}/conversations.parquet").orderBy("turn").collect()
    texts = {}
    for r in rows:
        texts.setdefault(r.conv_id, []).append(r.text or "")
    got = {r.doc: r["diff"] for r in OPERATIONS["unified_diff"][0](spark, DIR).collect()}
    assert set(got) == set(texts)
    for doc, diff in got.items():
        old, out, at = texts[doc][0].splitlines(), [], 0
        for line in diff.splitlines():
            if m := re.match(r"@@ -(\d+)(?:,(\d+))? ", line):
                start = int(m[1]) - (m[2] != "0")
                out += old[at:start]
                at = start
            elif line[0] == "+":
                out.append(line[1:])
            else:
                assert old[at] == line[1:]
                out += [line[1:]] if line[0] == " " else []
                at += 1
        assert out + old[at:] == texts[doc][-1].splitlines()


def test_block_match_by_hand(spark):
    """Blocks that only moved keep their identity, and every block of both versions is accounted for once."""
    rows = OPERATIONS["block_match"][0](spark, DIR).collect()
    turns = [(r.conv_id, str(r.turn)) for r in spark.read.parquet(f"{DIR}/conversations.parquet").collect()]
    old = [(r.doc, r.old_id) for r in rows if r.old_id and r.method != "near"]
    new = [(r.doc, r.new_id) for r in rows if r.new_id and r.method != "near"]
    assert sorted(old) == sorted(turns) and sorted(new) == sorted((d, t) for d, t in turns if d % 3 or t != "1")
    assert all(r.old_id == r.new_id for r in rows if r.method == "exact")


def test_moves_take_the_most_similar_first(spark):
    from quillon.operators.matching import moves, text_sim

    base = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(4)]
    gone = [("a", f"o{i}", i, "paragraph", t) for i, t in enumerate(base)] + [("a", "same", 9, "heading", base[0])]
    came = [("b", "n0", 0, "paragraph", base[0]), ("c", "n1", 1, "paragraph", base[0] + " tail"), ("b", "n2", 2, "paragraph", base[2] + " tail"), ("a", "n3", 3, "paragraph", base[3]), ("b", "n4", 4, "paragraph", None)]
    schema = "doc string, id string, position int, type string, text string"
    got = {(r.carried_id, r.replaced_id): (r.kind, round(r.confidence, 6)) for r in moves(spark.createDataFrame(gone, schema), spark.createDataFrame(came, schema)).collect()}
    assert got == {("o0", "n0"): ("moved", 1.0), ("o2", "n2"): ("edited_moved", round(text_sim(base[2], base[2] + " tail"), 6))}


def test_similar_pairs_of_copies_and_variants(spark):
    """All pairs of rows, copies in several blocks of keys among them; a text is split once, not once a shingle."""
    from pyspark.sql import functions as F

    from quillon.operators import search
    from quillon.operators.matching import shingle_set

    assert str(search.shingles(F.col("text"))).count("split") == 1
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words)] * 70 + [" ".join(words).upper()] + [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in range(0, 40, 5)] + ["one", "one  ", "two words", "", None]
    a = list(enumerate(texts)) + [(5, "other text of five words")]
    b = [(f"m{i}", t) for i, t in a[30:]]
    got = search.similar_pairs(spark.createDataFrame(a, "k long, text string"), spark.createDataFrame(b, "m string, text string"), "k", "m", "text", 0.8).collect()
    sets = lambda rows: [(k, shingle_set(t or "")) for k, t in rows]
    want = [(k, m, 2 * len(x & y) / (len(x) + len(y))) for k, x in sets(a) for m, y in sets(b) if x and y and 2 * len(x & y) >= 0.8 * (len(x) + len(y))]
    assert sorted((r.k, r.m, round(r.similarity, 9)) for r in got) == sorted((k, m, round(s, 9)) for k, m, s in want)


def test_stems_try_a_pattern_only_on_its_ending(spark):
    from pyspark.sql import functions as F

    from quillon.functions import stemming

    assert str(stemming.stems(F.col("w"))).count("rlike(") == sum(len(rules) for _, rules in stemming.STEPS)
    words = [f"{a}{b}" for a in ("", "x", "ca", "hop", "relat", "tt", "oscill", "é") for b in ("", "s", "ies", "sses", "eed", "ing", "izing", "ed", "y", "ational", "tional", "ion", "sion", "ement", "ment", "ent", "er", "e", "ll", "alism", "ness", "icate", "ж")]
    got = spark.createDataFrame([(words,)], "w array<string>").select(stemming.stems(F.col("w"))).first()[0]
    assert got == [stemming.stem(w) for w in words]


def test_ranked_search_cuts_texts_once(spark):
    from quillon.operators import search

    out = search.bm25(spark.createDataFrame([(1, "er and er"), (2, "and"), (3, "er and")], "k long, t string"), "k", "t", "er and")
    assert out._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") == 2
    assert [r.k for r in out.orderBy("rank").collect()] == [1, 3]
