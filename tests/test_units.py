"""Small cases of walks, corpus parsing, history, dates, the second dialect, tree reflection and streams."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import stemming, temporal
from quillon.operators import history, search
from quillon.operators.ranking import ranked
from quillon.operators.walk import walk
from quillon.plans import dql, reflect
from quillon.plans.catalogue import CATALOGUE
from quillon.plans.lower import execute
from quillon.plans.parser import QueryError, parse
from quillon.sources import corpus, mapping
from quillon.sources.catalog import Catalog
from quillon.streaming import feed


def brute_walk(seeds, edges, depth, fronts=()):
    out, level = [], [(s, (s,), False) for s in seeds]
    for d in range(1, depth + 1):
        after = []
        for k, path, cycle in level:
            nxt = sorted({b for a, b in edges if a == k}) if d < depth else []
            stop = "cycle" if cycle else "frontier" if k in fronts else "interior" if nxt else "depth" if d >= depth else "leaf"
            out.append((k, d, path, stop))
            if stop == "interior":
                after += [(b, (*path, b), b in path) for b in nxt]
        level = after
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_walk(spark, seed):
    r = random.Random(seed)
    edges = sorted({(r.randrange(9), r.randrange(9)) for _ in range(14)})
    s = spark.createDataFrame([(0, False), (1, True), (2, False)], "key int, frontier boolean")
    e = spark.createDataFrame(edges, "src int, dst int")
    got = sorted((x.key, x.depth, tuple(x.path), x.stop) for x in walk(s, e, 4, ordinal=True).collect())
    want = [(k, d, p, "frontier" if k == 1 and d == 1 else t) for k, d, p, t in brute_walk([0, 1, 2], edges, 4)]
    want = [w for w in want if not (w[2][0] == 1 and w[1] > 1)]
    assert got == want
    least = {}
    for k, d, p, _ in got:
        least[k] = min(least.get(k, (9, ())), (d, p))
    assert sorted((x.key, (x.depth, tuple(x.path))) for x in walk(s, e, 4, distinct=True).collect()) == sorted(least.items())
    assert walk(s.limit(0), e, 3).count() == 0


def test_ranked(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.lit(1).alias("n"))
    assert sorted((r.x + 1, r["rank"]) for r in ranked(df, [F.col("x")], "rank").collect()) == [(i, i) for i in range(1, 1001)]


def test_search_parse():
    got = [(t.words, t.prefix) for t in search.parse_search('guides/onboarding "exact phrase" other* --- a"b')]
    assert got == [(("guides", "onboarding"), False), (("exact", "phrase"), False), (("other",), True), (("a",), False), (("b",), False)]


def test_stems_are_those_of_sqlite(spark):
    """Words of the documents and words made of stems and suffixes, against the porter tokenizer of SQLite's index."""
    import random
    import sqlite3

    r = random.Random(5)
    ends = [*stemming.STEP2, *stemming.STEP3, *stemming.STEP4, "ion", "s", "es", "ed", "eed", "ing", "y", "e", "ll", ""]
    words = {w for t in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").dropna().collect() for w in stemming.words(t.text)}
    words |= {"".join(r.choice("abeioutrslyzwxnm") for _ in range(r.randint(1, 5))) + "".join(r.choice(ends) for _ in range(r.randint(0, 3))) for _ in range(20000)}
    words = sorted(words | {"caf\u00e9s", "x" * 70 + "ing", "\u00fc", "yb", "eed"})
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(words))
    want = {d: t for t, d in db.execute("select term, doc from v")}
    folded = [stemming.folded(w) for w in words]
    assert [stemming.stem(w) for w in folded] == [want[i] for i in range(len(words))]
    rows = spark.createDataFrame(list(enumerate(folded)), "i int, w string").select("i", "w", stemming.stems(F.array("w"))[0].alias("s")).collect()
    assert {x.i: x.s for x in rows} == want
    assert all(x.w.startswith(search._head(x.s)) for x in rows)


def test_search_meets_stems(spark):
    df = spark.createDataFrame([(1, "Relational databases were running"), (2, "He runs; relate them"), (3, "Caf\u00e9 run away run away"), (4, None)], "id int, text string")
    ids = lambda q: sorted(r.id for r in search.text_filter(df, "text", q).collect())
    assert ids("runs") == [1, 2, 3] and ids("relate") == [1, 2] and ids("cafe") == [3] and ids('"database was"') == [] and ids('"databases were run"') == [1]
    assert ids("databas*") == [1] and ids('"running away"') == [3] and ids('"away runs"') == [3]
    count = df.select("id", search.hits(search.tokens(F.col("text")), search.Term(("run", "away"))).alias("n")).collect()
    assert {r.id: r.n for r in count} == {1: 0, 2: 0, 3: 2, 4: 0}
    assert {(r.term, r.key, r.tf) for r in search.postings(df.withColumnRenamed("id", "key"), "key", "text").where("key = 3").collect()} == {("cafe", 3, 1), ("run", 3, 2), ("awai", 3, 2)}


def test_search_cases(spark):
    df = spark.createDataFrame([(1, "Red furnace, red door"), (2, "the red DOOR"), (3, None), (4, "")], "id int, text string")
    ids = lambda q: sorted(r.id for r in search.text_filter(df, "text", q).collect())
    assert ids("red door") == [1, 2] and ids('"red door"') == [1, 2] and ids('"furnace red"') == [1] and ids("fur*") == [1] and ids("---") == []
    assert [r.id for r in search.bm25(df, "id", "text", "red", 1).collect()] == [1]
    sim = spark.createDataFrame([("a b c d", "a b c d e"), ("", ""), ("x", "x"), ("x", "")], "a string, b string").select(search.dice(search.shingles("a"), search.shingles("b")).alias("d"))
    assert [round(r.d, 6) for r in sim.collect()] == [0.8, 1, 1, 0]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "id int, v array<double>")
    assert [(r.id, round(r.cosine, 4)) for r in search.vector_search(v, "id", "v", [1, 0], 9).collect()] == [(1, 1), (3, 0.7071), (2, 0)]


MARKDOWN = """---
title: "My note"
tags: [a, b]
n: 3
---
# Top
Some text with [a link](other.md) and [[Page|p]].
owner:: Ann

- item
  - [x] done <https://x.example/y>
  - [ ] open
1. one

## Sub
> quote
| a | b |
|---|---|
| 1 | 2 |
```py
# not a heading [no](link)
```
Setext
------
***
last
"""


YAML = """# c
title: "My: note"   # why
f: 1.50
tags:
- a
- 'b''c'
nested:
  deep:
    x: yes it is
      going on
    y: ~
  list:
    - p: 1
      q: [1, {r: s}]
    - z
flow: {"b": [x y, "q,r"], c}
url: http://x.y/z#frag
lit: |
  one
    two

fold: >-
  a
  b

  c
multi: [a,
  b]
e: []
"""


def test_mappings():
    want = [
        ("title", "scalar", 0, "My: note", "string"), ("f", "scalar", 0, "1.5", "number"), ("tags", "list", 0, "a", "string"), ("tags", "list", 1, "b'c", "string"),
        ("nested.deep.x", "scalar", 0, "yes it is going on", "string"), ("nested.deep.y", "scalar", 0, None, "null"), ("nested.list", "list", 0, '[{"p":1,"q":[1,{"r":"s"}]},"z"]', "json"),
        ("flow.b", "list", 0, "x y", "string"), ("flow.b", "list", 1, "q,r", "string"), ("flow.c", "scalar", 0, None, "null"), ("url", "scalar", 0, "http://x.y/z#frag", "string"),
        ("lit", "scalar", 0, "one\n  two\n", "string"), ("fold", "scalar", 0, "a b\nc", "string"), ("multi", "list", 0, "a", "string"), ("multi", "list", 1, "b", "string"),
    ]
    assert mapping.rows_of(YAML, "yaml") == want
    assert mapping.rows_of(YAML.replace("\n", "\r\n"), "yaml") == want


@pytest.mark.parametrize("text", ["a: 1\na: 2", "- x", "plain", "a: &x 1", "a: [1", "\ta: 1", "a: b: c", "", "a: 1\n b: 2", 'a: "x', "a: 1\n- b", None])
def test_malformed_mappings_have_no_rows(text):
    assert mapping.rows_of(text, "yaml") == []


def test_json_mappings():
    assert mapping.rows_of('{"a": {"b": [1, 2.0]}, "c": [[1]], "c": 3}', "json") == [("a.b", "list", 0, "1", "number"), ("a.b", "list", 1, "2", "number"), ("c", "scalar", 0, "3", "number")]
    assert [mapping.rows_of(t, "json") for t in ("[1]", '{"a": NaN}', '{"a": 1,}', "")] == [[], [], [], []]


def test_blocks(spark):
    bs = corpus.parse_blocks(MARKDOWN)
    assert [b.type for b in bs] == ["frontmatter", "heading", "paragraph", "list_item", "task", "task", "list_item", "heading", "blockquote", "table", "code", "heading", "thematic_break", "paragraph"]
    assert [b.parent for b in bs[3:7]] == [None, 3, 3, None] and [b.checked for b in bs[4:6]] == [True, False]
    for a, b in zip(bs, bs[1:]):
        assert a.end <= b.start and not MARKDOWN[a.end : b.start].strip()
    docs = spark.createDataFrame([(1, MARKDOWN, "a.md"), (2, None, "other.md"), (3, "", "c.md")], "id int, text string, path string")
    b = corpus.blocks(docs, "id", "text")
    assert b.count() == len(bs)
    assert [(r.text, r.checked) for r in corpus.tasks(b, "id").orderBy("ordinal").collect()] == [("done <https://x.example/y>", True), ("open", False)]
    links = corpus.resolved(corpus.links(b, "id"), docs, "path", "id")
    assert sorted((r.kind, r.dst) for r in links.collect()) == [("md:autolink", "https://x.example/y"), ("md:link", "2"), ("md:wikilink", "phantom:Page")]
    assert [(r.dst, r.n) for r in corpus.stale_links(links, "id").collect()] == [("phantom:Page", 1)]
    props = sorted((r.name, r.ord, r.value, r.kind) for r in corpus.properties(b, "id").collect())
    assert props == [("n", 0, "3", "number"), ("owner", 0, "Ann", "string"), ("tags", 0, "a", "string"), ("tags", 1, "b", "string"), ("title", 0, "My note", "string")]
    assert sorted((r.heading, r.first, r.last) for r in corpus.sections(b, "id").collect()) == [("Setext", 11, 13), ("Sub", 7, 10), ("Top", 1, 13)]
    assert corpus.under_heading(b, "id", "sub").count() == 4
    assert [r.line for r in corpus.outline(b, "id").orderBy("ordinal").collect()] == ["Top", "  Sub", "  Setext"]


@pytest.mark.parametrize("seed", range(30))
def test_edit_script(seed):
    r = random.Random(seed)
    a, b = ([r.choice("abc") for _ in range(r.randrange(12))] for _ in range(2))
    steps = history.edit_script(a, b)
    assert [a[i] for c, i, _ in steps if c != "+"] == a and [b[j] for c, _, j in steps if c != "-"] == b
    assert all(a[i] == b[j] for c, i, j in steps if c == " ")
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    assert sum(c == " " for c, *_ in steps) == n[-1][-1]


def test_unified():
    a, b = "\n".join(map(str, range(20))), "\n".join(str(x) for x in [*range(5), "x", *range(6, 20), "end"])
    want = [ln for ln in difflib.unified_diff(a.split("\n"), b.split("\n"), lineterm="")][2:]
    assert history.unified(a, b).split("\n") == want
    assert history.unified(a, a) == ""


def test_durations(spark):
    s = temporal.seconds
    assert (s("1 month"), s("1h30m"), s("2 days, 3 hours"), s("PT1H30M"), s("-PT90S"), s("1 hour 30 minutes"), s("1.5s")) == (2592000, 5400, 183600, 5400, -90, 5400, 1.5)
    assert [s(x) for x in ("P", "PT", "3", "1 fortnight", "1h,,2m", ",1h", "")] == [None] * 7
    c = Catalog(today="2026-10-15").add("t", spark.createDataFrame([("2026-01-31", "1h 30m"), ("2024-02-29", "x"), (None, None)], "d string, u string"))
    q = 't { d, a: d.plus("1 month"), y: d.plus("1 year"), s: d.plus(3600), u: dur(u), n: date("eom"), i: dur("2d 3h").dur_iso() order by d }'
    rows = [tuple(r) for r in execute(c, q).collect()]
    assert rows[0] == ("2024-02-29", "2024-03-29", "2025-02-28", "2024-02-29T01:00:00Z", None, "2026-10-31", "P2DT3H")
    assert rows[1] == ("2026-01-31", "2026-02-28", "2027-01-31", "2026-01-31T01:00:00Z", 5400.0, "2026-10-31", "P2DT3H")
    assert rows[2][1:5] == (None, None, None, None)


def test_bindings(spark):
    c = Catalog(functions={"double": lambda x: x * 2}).add("t", spark.range(10).withColumnRenamed("id", "k"))
    assert [r.k for r in execute(c, "t { k where k > ${n} and k in ${ks} order by k limit ${m} }", {"n": 3, "ks": [2, 5, 7, 9], "m": 2}).collect()] == [5, 7]
    assert [tuple(r) for r in execute(c, "${rows} { a, b: double(a) order by a desc }", {"rows": [{"a": 1}, {"a": 4}]}).collect()] == [(4, 8), (1, 2)]
    assert [r.k for r in execute(c, "t { k where ^${rows} exists { where a == ^k } order by k }".replace("^${rows}", "${rows}"), {"rows": [{"a": 1}, {"a": 4}]}).collect()] == [1, 4]
    assert [r.n for r in execute(c, "t { n: 0^t count { where k < ^k } order by k limit 3 }").collect()] == [0, 1, 2]
    with pytest.raises(QueryError):
        parse("t { k where k > ${n} }")


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_show_reads_back(name):
    tree = parse(CATALOGUE[name][0])
    assert parse(reflect.show(tree)) == tree
    assert reflect.transform(tree, lambda e: e) == tree


def test_reflect():
    tree = parse("orders { o_orderkey where o_custkey == ^x }")
    assert reflect.references(tree) == {(0, "orders"), (0, "o_orderkey"), (0, "o_custkey"), (1, "x")}
    assert {x[0] for x in reflect.visit(tree)} >= {"block", "op", "name"}


def test_dql(spark):
    docs = spark.createDataFrame([("a/x.md", ["t", "u"], 3), ("a/y.md", [], 5), ("b/z.md", ["t"], None)], "path string, tags array<string>, n int")
    links = spark.createDataFrame([("a/x.md", "b/z.md"), ("b/z.md", "a/y.md")], "src string, dst string")
    c = Catalog().add("docs", docs).add("links", links, ["src", "dst"])
    run = lambda q: [tuple(r) for r in execute(c, dql.translate(q).tree).collect()]
    assert run('TABLE n FROM "a" SORT file.path DESC') == [("a/y.md", 5), ("a/x.md", 3)]
    assert run('LIST FROM #t AND -"b"') == [("a/x.md",)]
    assert run("LIST FROM [[b/z.md]]") == [("a/x.md",)] and run("LIST FROM outgoing([[b/z.md]])") == [("a/y.md",)]
    assert run("TABLE WITHOUT ID t FLATTEN tags AS t SORT file.path, t") == [("t",), ("u",), ("t",)]
    assert run("TABLE length(rows) AS c GROUP BY default(n, 0) AS k SORT k") == [(0, 1), (3, 1), (5, 1)]
    for bad in ("TABLE round(n)", "TASK n", 'LIST FROM csv("x.csv")', "LIST LIMIT 1 WHERE n > 2", "PICTURE n"):
        with pytest.raises(QueryError):
            dql.translate(bad)


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("k"))
    rows.where("seq < 60").write.parquet(src)
    go = lambda: feed.drain(feed.tail(spark, src, rows.schema, 1), feed.append(out), str(tmp_path / "cp")).awaitTermination()
    go()
    assert spark.read.parquet(out).count() == 60
    rows.where("seq >= 60").write.mode("append").parquet(src)
    go()
    got = spark.read.parquet(out)
    assert got.count() == 100 and got.select("seq").distinct().count() == 100


def test_sync_cases(spark):
    now = dt.datetime(2026, 1, 31)
    gone = spark.createDataFrame([(1, dt.datetime(2026, 1, 2)), (2, dt.datetime(2025, 12, 1))], "id int, deleted_at timestamp")
    assert [r.id for r in feed.recoverable(gone, str(now)).collect()] == [1]
    cache = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "path string, mtime int, size int")
    assert [r.path for r in feed.stale(cache, spark.createDataFrame([("a", 1, 2), ("b", 3, 2), ("c", 1, 1)], cache.schema)).orderBy("path").collect()] == ["b", "c"]
