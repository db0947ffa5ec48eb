"""The store, its relations and functions, and the operators around it, against DuckDB."""

import pytest
from test_queries import DIR, duck, plain  # noqa: F401

from quillon import tools
from quillon.operators import search, writes
from quillon.plans.domain import DOMAIN, talks
from quillon.plans.lower import execute
from quillon.plans.parser import QueryError
from quillon.sources import corpus, store
from quillon.streaming import feed


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in DOMAIN.items() if sql))
def test_domain(name, spark, duck):  # noqa: F811
    query, sql = DOMAIN[name]
    df = query(spark, DIR)
    want = duck.execute(sql)
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    got = sorted(([plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    want = sorted(([plain(v) for v in r] for r in want.fetchall()), key=str)
    assert got and got == want


@pytest.fixture(scope="module")
def small(spark):
    docs = [
        ("d_1", "a/one.md", "---\ntitle: One\nlayer: canon\n---\n\n# First\n\n- [ ] do\n  - [x] done\n\nSee [two](a/two.md#part) and [none](gone.md).\n", False),
        ("d_2", "a/two.md", "# Second\n\nPlain furnace text.\n\n## Part\n\nMore.\n", False),
        ("d_3", "b.md", "old\n", True),
        ("d_4", "c.md", None, False),
    ]
    revisions = [("d_1", 1, "x"), ("d_1", 2, "y"), ("d_3", 1, "old")]
    return store.tables(spark.createDataFrame(docs, "id string, path string, text string, deleted boolean"), spark.createDataFrame(revisions, "doc string, seq int, text string"), ("layer",))


@pytest.mark.parametrize(
    "text, want",
    [
        ("docs { _path }", [("a/one.md",), ("a/two.md",), ("c.md",)]),
        ("docs { _title }", [("One",), ("Second",), ("c.md",)]),
        ("links { _dst_node, _anchor }", [("d_2", "part"), ("phantom:gone.md", "")]),
        ("revisions { _doc_id, t: _doc._title, d: _doc._id }", [("d_1", "One", "d_1"), ("d_1", "One", "d_1"), ("d_3", None, "d_3")]),
        ("revisions { _id where _doc == null }", [("r_d_3_1",)]),
        ('blocks { _text where under("b_d_1_2") }', [("do",), ("done",)]),
        ('blocks { _text where has_anchor() }', [("See [two](a/two.md#part) and [none](gone.md).",)]),
        ('docs { _id where text("FURNACE") }', [("d_2",)]),
        ('nodes { _name where text("part") }', [("Part",)]),
        ("docs { _id where text(\"\") }", []),
        ("docs { _id, n: _blocks count { }, r: _revisions { _seq values } }", [("d_1", 4, [1, 2]), ("d_2", 4, []), ("d_4", 0, [])]),
    ],
)
def test_store(text, want, small):
    assert sorted((tuple(r) for r in execute(store.catalog(small), text).collect()), key=str) == sorted(want, key=str)


def test_functions_say_where_they_are_missing(small):
    for text in ('links { _id where text("x") }', 'docs { _id where within("a") }', 'docs { _id where semantic("unknown") > 0 }'):
        with pytest.raises(QueryError):
            execute(store.catalog(small), text)


def test_semantic(small):
    vectors = search.hashed_vectors(small["blocks"], "_id", "_text", 8).withColumnRenamed("vector", "_vector")
    held = small | {"blocks": small["blocks"].join(vectors, "_id")}
    q = vectors.where("_id = 'b_d_2_1'").first()._vector
    got = execute(store.catalog(held, {"heat": q}), 'blocks { _id where semantic("heat") > 0.999 }').collect()
    assert [r._id for r in got] == ["b_d_2_1"]


def test_resolve(spark):
    rows = DOMAIN["resolve"][0](spark, DIR).collect()
    texts = {r.id: r.text for r in talks(spark, DIR).collect()}
    assert len(rows) == 20
    for r in rows:
        words = r.preview.rstrip("\u2026").split()
        doc = "d_" + r._id.split("_")[2]
        assert r.locator == f"talks/{doc[2:]}.md#paragraph[{r._id.split('_')[3]}]" and len(words) <= 12 and " ".join(words) in texts[doc] and words[0] == "Said"


def test_tools_and_command_line(spark, small, tmp_path, capsys):
    c = store.catalog(small)
    assert [r._path for r in tools.call(c, "docs_list").collect()] == ["a/one.md", "a/two.md", "c.md"]
    assert tools.call(c, "docs_read", path="a/two.md").first().text == "# Second\n\nPlain furnace text.\n\n## Part\n\nMore."
    assert {(r.directory, r.n) for r in tools.call(c, "docs_tree").collect()} == {("", 3), ("a", 2)}
    assert tools.call(c, "blocks_search", text="furnace").first()._id == "b_d_2_1"
    assert {r.dst for r in tools.call(c, "links_stale").collect()} == {"phantom:gone.md"}
    with pytest.raises(QueryError):
        tools.call(c, "nothing")
    for n, df in small.items():
        df.write.parquet(f"{tmp_path}/{n}.parquet")
    tools.main(["query", str(tmp_path), "docs { _id limit 1 }"])
    assert capsys.readouterr().out.strip().endswith('{"_id": "d_1"}')


def test_directed_writes_keep_their_bound(spark):
    hits = spark.createDataFrame([("d", f"b{i}", i, "x") for i in range(5)], "doc string, id string, order int, raw string")
    assert writes.directed(hits, "remove", at_most=5).count() == 5
    with pytest.raises(Exception, match="more than 4 hits"):
        writes.directed(hits, "remove", at_most=4).collect()


def test_plan_digest(spark):
    rows = spark.createDataFrame([("d", i, "update", f"b{i}", "x", None, "y") for i in range(6)], "doc string, seq int, op string, id string, raw string, after string, expect string")
    digest = lambda df: writes.plan(df).first().digest
    assert digest(rows) == digest(rows.repartition(3)) != digest(rows.where("seq > 0"))


def test_embedding_stream_adds_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([("h1", "c1"), ("h2", "c2")], "content_hash string, ctx_hash string")
    each = feed.embedded(lambda b: b, str(tmp_path / "v"), lambda t: t, "m")
    each(rows.where("content_hash = 'h1'"), 0)
    each(rows, 1)
    each(rows, 1)
    got = spark.read.option("basePath", str(tmp_path / "v")).parquet(str(tmp_path / "v")).collect()
    assert sorted((r.content_hash, r.batch) for r in got) == [("h1", 0), ("h2", 1)]


NESTED = """---
title: One
see:
- /a/two.md
- d_1
- gone.md
- a/two.md
meta: {owner: ann}
---

# First

- [ ] do
  - mid
    - [x] deep #tag

See (due:: 3) and `[k:: v]` #tag #b/c
k:: v
- k:: true
"""


@pytest.fixture(scope="module")
def nested(spark):
    docs = spark.createDataFrame([("d_1", "a/one.md", NESTED), ("d_2", "a/two.md", "x"), ("d_3", "none.md", None)], "id string, path string, text string")
    return corpus.blocks(docs, "id", "text"), store.tables(docs, None, ("title", "meta.owner"), ("see",))


def test_properties_of_nested_front_matter_and_fields(nested):
    got = {(r.source, r.name, r.ord, r.value, r.kind, r.card) for r in corpus.properties(nested[0], "id").collect()}
    front = {("frontmatter", "see", i, v, "string", "list") for i, v in enumerate(["/a/two.md", "d_1", "gone.md", "a/two.md"])}
    front |= {("frontmatter", "title", 0, "One", "string", "scalar"), ("frontmatter", "meta.owner", 0, "ann", "string", "scalar")}
    assert got == front | {("inline", "due", 0, "3", "number", "scalar"), ("inline", "k", 0, "v", "string", "list"), ("inline", "k", 1, "true", "bool", "list")}
    assert sorted((r.name, r.ord, r.value) for r in corpus.computed(nested[0], "id").collect()) == [("_tags", 0, "tag"), ("_tags", 1, "b/c"), ("_title", 0, "First")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("docs { s, r: refs(s) { _id values } flatten see as s }", [("/a/two.md", ["d_2"]), ("a/two.md", ["d_2"]), ("d_1", ["d_1"]), ("gone.md", [])]),
        ('docs { _id, n: refs("/a/two.md") count { } where refs(_path) exists { title == "One" } }', [("d_1", 1)]),
        ('refs("a/two.md") { _id }', [("d_2",)]),
        ("docs { _id where size(refs(_path)) == 1 }", [("d_1",), ("d_2",), ("d_3",)]),
        ("docs { _id, meta.owner where meta.owner }", [("d_1", "ann")]),
        ('blocks { _text where under("b_d_1_2") }', [("deep #tag",), ("do",), ("mid",)]),
        ('blocks { _text where under_kind("task", "do") }', [("deep #tag",), ("mid",)]),
        ('blocks { _text where under_kind("list_item") }', [("deep #tag",)]),
        ('$it { n: docs count { }, b: blocks count { where _type == "task" } }', [(3, 2)]),
    ],
)
def test_references_and_ancestors(text, want, nested):
    assert sorted((tuple(r) for r in execute(store.catalog(nested[1]), text).collect()), key=str) == want


def test_reference_lists_keep_order(nested):
    docs = nested[1]["docs"]
    assert sorted((r.pos, r.dst) for r in store.references(docs, docs.select("_title", "see"), "_title", "see").collect()) == [(0, "d_2"), (1, "d_1"), (3, "d_2")]
    for text in ("docs { n: size(refs(see)) }", 'docs { _id where refs("a", "b") exists { } }'):
        with pytest.raises(QueryError):
            execute(store.catalog(nested[1]), text)


def test_blocks_leave_python_in_pieces():
    """However many documents a batch has, few blocks are held at once, and all come in order."""
    import pyarrow as pa

    ddl = "doc long, " + corpus.BLOCKS
    schema = corpus.to_arrow_schema(corpus.T.StructType.fromDDL(ddl))
    texts = ["# T\n\n- a\n  - b\n\nText.\n", ""] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(texts)], names=["doc", "_text"])
    out = list(corpus._parsed(iter([batch]), schema))
    assert len(out) > 1 and max(p.num_rows for p in out) < corpus.CHUNK + 4
    got = pa.Table.from_batches(out)
    assert got["doc"].to_pylist() == [2 * d for d in range(3000) for _ in range(4)]
    assert got["text"].to_pylist() == ["T", "a", "b", "Text."] * 3000 and got["above"].to_pylist()[2] == [{"ordinal": 1, "type": "list_item", "text": "a"}]
