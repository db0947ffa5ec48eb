"""Edits of documents and matching of blocks."""

from quillon.operators.edits import apply_edits, fresh_id
from quillon.operators.matching import match_blocks, text_sim


def test_edits(spark):
    blocks = spark.createDataFrame([(1, "a", 0, "one"), (1, "b", 1, "two"), (1, "c", 2, "three"), (2, "x", 0, "same")], "doc int, id string, order long, raw string")
    edits = spark.createDataFrame(
        [(1, 1, "insert", "n", "new", "a", None, None), (1, 2, "update", "b", "TWO", None, None, "two"), (1, 3, "update", "b", "no", None, None, "two"), (1, 4, "move", "c", None, None, None, None), (1, 5, "split", "a", None, None, 1, None), (1, 6, "remove", "z", None, None, None, None), (1, 7, "merge", "n", "-", None, None, None), (3, 1, "insert", None, "first", None, None, None), (1, 8, "split", "c", None, None, 9, None), (1, 9, "cut", "c", None, None, None, None)],
        "doc int, seq int, op string, id string, raw string, after string, at int, expect string",
    )
    got, done = apply_edits(blocks, edits)
    assert [(r.id, r.raw) for r in got.where("doc = 1").orderBy("order").collect()] == [("c", "three"), ("a", "o"), (fresh_id(1, 5), "ne"), ("n", "new-TWO")]
    assert [(r.id, r.raw) for r in got.where("doc = 2").collect()] == [("x", "same")] and [(r.id, r.raw) for r in got.where("doc = 3").collect()] == [(fresh_id(3, 1), "first")]
    assert {r.seq for r in done.where("doc = 1 and error is not null").collect()} == {3, 6, 8, 9}


def test_matching(spark):
    s = "doc int, id string, ordinal int, text string"
    base = "the quick brown fox jumps over the lazy dog again and again"
    old = spark.createDataFrame([(1, "a", 0, "same"), (1, "b", 1, "same"), (1, "c", 2, "Some  Case"), (1, "d", 3, base), (1, "e", 4, "gone entirely from here"), (2, "f", 0, None)], s)
    new = spark.createDataFrame([(1, "1", 0, base + " now"), (1, "2", 1, "same"), (1, "3", 2, "some case"), (1, "4", 3, "fresh words only stand here"), (1, "5", 4, "same"), (2, "6", 0, "")], s)
    got = {(r.doc, r.old_id, r.new_id, r.method) for r in match_blocks(old, new).collect()}
    assert got == {(1, "a", "2", "exact"), (1, "b", "5", "exact"), (1, "c", "3", "normalised"), (1, "d", "1", "scored"), (1, "e", None, "deleted"), (1, None, "4", "inserted"), (2, "f", "6", "exact")}
    assert match_blocks(old.limit(0), new.where("doc = 2")).collect()[0].method == "inserted"
    assert text_sim("", "") == 1 and text_sim("a b", "a c") == 0
