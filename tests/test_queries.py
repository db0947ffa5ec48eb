"""The query language: every catalogue query against DuckDB, and small cases of absent, empty and mixed values."""

import duckdb
import pytest

from quillon.plans import catalogue
from quillon.plans.catalogue import CATALOGUE, TABLES
from quillon.plans.lower import execute
from quillon.plans.parser import QueryError, parse
from quillon.sources.catalog import Catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return catalogue.tables(spark, DIR)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in [*TABLES, "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"create view {n} as select * from '{DIR}/{n}.parquet'")
    return con


def plain(v):
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_catalogue(name, tables, duck):
    text, sql = CATALOGUE[name]
    df = execute(tables, text)
    want = duck.execute(sql)
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    key = lambda r: str(r)
    got = sorted(([plain(v) for v in r] for r in df.select(*cols).collect()), key=key)
    assert got == sorted(([plain(v) for v in r] for r in want.fetchall()), key=key)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, "ann", 3.0, [1, 2]), (2, None, None, []), (3, "bob", 0.0, None), (4, "ann", 5.0, [None, 7])]
    return Catalog().add("people", spark.createDataFrame(rows, "id int, name string, rank double, tags array<int>"))


@pytest.mark.parametrize(
    "text, want",
    [
        ("people { id where rank }", [(1,), (4,)]),
        ("people { id where name == null }", [(2,)]),
        ("people { id where not (rank < 4) }", [(2,), (4,)]),
        ("people { id where name < 3 }", []),
        ("people { id, rank order by rank desc }", [(4, 5.0), (1, 3.0), (3, 0.0), (2, None)]),
        ("people { id, t flatten tags as t }", [(1, 1), (1, 2), (3, None), (4, None), (4, 7)]),
        ("people { name, n: count(rank), s: sum(rank) group by name order by name }", [("ann", 2, 8.0), ("bob", 1, 0.0), (None, 0, 0.0)]),
        ("people { id, m: max(tags), k: tags count { where $it > 1 } order by id }", [(1, 2, 1), (2, None, 0), (3, None, 0), (4, 7, 1)]),
        ("people { select distinct name order by name limit 2 }", [("ann",), ("bob",)]),
        ("people { id, x: rank / 0, y: nothing order by id limit 1 }", [(1, None, None)]),
        ("people { id where ^people exists { where name == ^name offset 1 } }", [(1,), (4,)]),
        ("people { id where ^people none { where name == ^name offset 1 } }", [(2,), (3,)]),
        ("people { id where ^people exists { where name == ^name limit 0 } }", []),
        ("people { id, n: ^people count { where name == ^name limit 1 } order by id }", [(1, 1), (2, 1), (3, 1), (4, 1)]),
        ("people { id, n: ^people count { select distinct name where id <= ^id } order by id }", [(1, 1), (2, 2), (3, 3), (4, 3)]),
        ("people { id, n: count($rows), s: sum($rows { rank * 2 values }) order by id }", [(1, 1, 6.0), (2, 1, 0.0), (3, 1, 0.0), (4, 1, 10.0)]),
        ("people { id, s: sum(tags), c: count(tags), a: any(tags), e: all(tags) order by id }", [(1, 3.0, 2, True, True), (2, 0.0, 0, False, True), (3, 0.0, 0, False, True), (4, 7.0, 1, True, False)]),
        ("people { id, s: sum(nope), f: sum(5) order by id limit 1 }", [(1, 0.0, 5.0)]),
        ("people { id where false and foo(1) }", []),
        ("people { id where id > 9 and foo(1) }", []),
        ("people { id where id > 0 or foo(1) }", [(1,), (2,), (3,), (4,)]),
        ('people { id where name in (1, "ann") }', [(1,), (4,)]),
        ("people { id where rank in (0, null) }", [(2,), (3,)]),
        ('people { id where rank in range("1..4") }', [(1,)]),
        ('people { id where rank in range("3...5") }', [(1,)]),
        ('people { id where rank in range("..3") }', [(1,), (3,)]),
        ('people { id where rank in range("a..z") or rank in range("../3") }', []),
        ("people { id where $key == 3 }", [(3,)]),
        ("people { id, n: $it.name order by id limit 1 }", [(1, "ann")]),
        ("people { id, m: tags single { where $it > 1 } order by id }", [(1, 2), (2, None), (3, None), (4, 7)]),
        ("people { name, top: $rows first { id values order by rank desc } group by name order by name }", [("ann", 4), ("bob", 3), (None, 2)]),
        ("people { name, n: $rows collect { id values where rank > 0 } group by name order by name }", [("ann", [1, 4]), ("bob", []), (None, [])]),
        ("people { name, n: collect($rows { select distinct name values }) group by name order by name }", [("ann", ["ann"]), ("bob", ["bob"]), (None, [])]),
        ("people { id, g: tags { k, n: count($rows) group by k: $it % 2 order by k } order by id limit 1 }", [(1, [(0.0, 1), (1.0, 1)])]),
        ("people { id, n: tags count { select distinct $it values } order by id }", [(1, 2), (2, 0), (3, 0), (4, 2)]),
        ("people { id, b: ^people first { id values where id < ^id order by id desc }, c: ^people first { id values where id >= ^rank order by id } order by id }", [(1, None, 3), (2, 1, None), (3, 2, 1), (4, 3, None)]),
        ("people { id, n: ^people count { where rank > ^rank } order by id }", [(1, 1), (2, 0), (3, 2), (4, 0)]),
    ],
)
def test_absent_values(text, want, small):
    got = [tuple(r) for r in execute(small, text).collect()]
    assert got == want if "order by" in text else sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text", ["people", "people { where id == 1 select id }", "people { id, id }", "people { name having id }", "people { id + 1 }", "people { id } x", "people { id # }"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize("text", ["people single { id }", "people { id, m: tags single { $it > 0 } }", "people { id, s: ^people single { id values where name == ^name } }", "people { id where true and foo(1) }", "people { id where id > 0 and foo(1) }", "people { s: sum(name) }", "people { a: b, b: a }", "people { name, n: count($rows) where n > 1 group by name }", "people { n: count($rows) group by k: n + 1 }", 'people { id where name ~ "(?=a)" }', 'people { id where name ~ "(a)\\\\1" }'])
def test_evaluation_errors(text, small):
    with pytest.raises(Exception):
        execute(small, text).collect()


def test_single_and_default_order(small):
    assert [tuple(r) for r in execute(small, "people single { id where id == 3 }").collect()] == [(3,)]
    assert execute(small, "people single { id where id == 9 }").collect() == []
    assert [r.id for r in execute(small, "people { id where id <> 0 or true }".replace("<>", "!="), ordered=True).collect()] == [1, 2, 3, 4]


def test_plans(tables):
    """No quadratic join for the nearest row before, and hash aggregates for groups."""
    near = execute(tables, CATALOGUE["asof"][0])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in near and "Window" in near
    assert "SortAggregate" not in execute(tables, CATALOGUE["group_basic"][0])._jdf.queryExecution().executedPlan().toString()


def test_semi_join_plan(tables):
    plan = execute(tables, CATALOGUE["semi"][0])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "PythonUDF" not in plan


def test_whole_walk_and_durations_against_python(spark):
    """All nations of region 0 are walked, and durations of a day and more are written, whatever the SQL says."""
    d = "/root/testdata/sf0.01"
    own = [r.n_nationkey for r in spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 0").collect()]
    paths, level = [], [(k,) for k in own]
    for _ in range(4):
        paths += level
        level = [(*p, k) for p in level if p[-1] not in p[:-1] for k in own]
    got = catalogue.QUERIES["follow_cycle"](spark, d).collect()
    assert sorted((r.n_nationkey, r.d) for r in got) == sorted((p[-1], len(p)) for p in paths) and len(own) == 5

    def text(n):
        parts = [(n // 86400, "d"), (n // 3600 % 24, "h"), (n // 60 % 60, "m"), (n % 60, "s")]
        return " ".join(f"{x}{u}" for x, u in parts if x) or "0s"

    rows = catalogue.QUERIES["durations"](spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/events.parquet").count()
    assert all(r.d == text(r.event_id * 61) for r in rows) and any("d" in r.d for r in rows)
