"""Structural edits of documents that are lists of blocks: insert, update, move, remove, split, merge.

Blocks: doc, id, order, raw. Edits: doc, seq, op, id, and as the op needs: raw (new text), after (id that the block goes
behind; null: the front), at (code point of a split), expect (the text that the block must have). Edits of a document
apply in the order of seq, each to the outcome of those before; a failed one changes nothing and says why. Documents
are independent, so blocks and edits meet by one shuffle on doc; a document must fit in a task's memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

OPS = ("insert", "update", "move", "remove", "split", "merge")


class Conflict(ValueError):
    """An edit that doesn't fit the document."""


def fresh_id(doc: object, seq: object) -> str:
    """Id of the block that an edit makes: the same whenever the job runs again."""
    return "b_" + hashlib.sha256(f"{doc}|{seq}".encode()).hexdigest()[:12]


def apply_one(blocks: list[tuple[str, str]], op: str, new: str, id_: str | None, raw: str | None, after: str | None, at: int | None, expect: str | None) -> list[tuple[str, str]]:
    """The (id, raw) list after one edit."""
    place = {b: i for i, (b, _) in enumerate(blocks)}

    def find(x: str | None) -> int:
        if x not in place:
            raise Conflict(f"no block {x}")
        return place[x]

    if op not in OPS:
        raise Conflict(f"unknown edit {op}")
    if op == "insert":
        i = 0 if after is None else find(after) + 1
        return [*blocks[:i], (id_ or new, raw or ""), *blocks[i:]]
    i = find(id_)
    if expect is not None and blocks[i][1] != expect:
        raise Conflict("the block has changed")
    if op == "update":
        return [*blocks[:i], (id_, raw or ""), *blocks[i + 1 :]]
    rest = blocks[:i] + blocks[i + 1 :]
    if op == "remove":
        return rest
    if op == "move":
        if after == id_:
            raise Conflict("a block can't follow itself")
        j = 0 if after is None else [b for b, _ in rest].index(blocks[find(after)][0]) + 1
        return [*rest[:j], blocks[i], *rest[j:]]
    if op == "split":
        text = blocks[i][1]
        if at is None or not 0 < at < len(text):
            raise Conflict("a split lies inside the block")
        return [*blocks[:i], (id_, text[:at]), (new, text[at:]), *blocks[i + 1 :]]
    if i + 1 == len(blocks):
        raise Conflict("no block to merge with")
    return [*blocks[:i], (id_, blocks[i][1] + (raw or "") + blocks[i + 1][1]), *blocks[i + 2 :]]


def apply_edits(blocks: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, outcomes): the new snapshot, and per edit seq with its error or null."""
    doc = blocks.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", doc), *T.StructType.fromDDL("kind string, id string, order long, raw string, error string").fields])
    need = {"id": "string", "raw": "string", "after": "string", "at": "int", "expect": "string"}
    edits = edits.select(F.col("doc").alias("doc"), F.col("seq").cast("long").alias("seq"), "op", *(F.col(c).cast(t).alias(c) if c in edits.columns else F.lit(None).cast(t).alias(c) for c, t in need.items()))

    arrow = to_arrow_schema(schema)
    last = lambda *key: [(x is None, x) for x in key]  # nulls are last

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        d = (a if a.num_rows else b)["doc"][0].as_py()
        rows = sorted(zip(*(a[c].to_pylist() for c in ("order", "id", "raw"))), key=lambda r: last(*r[:2]))
        now = [(i, r) for _, i, r in rows]
        out = []
        for seq, op, id_, raw, after, at, expect in sorted(zip(*(b[c].to_pylist() for c in ("seq", "op", *need))), key=lambda r: last(r[0])):
            error = None
            try:
                now = apply_one(now, op, fresh_id(d, seq), id_, raw, after, at, expect)
            except Conflict as e:
                error = str(e)
            out.append((d, "edit", None, seq, None, error))
        out += [(d, "block", i, n, r, None) for n, (i, r) in enumerate(now)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    rows = blocks.select("doc", "id", "order", "raw").groupBy("doc").cogroup(edits.groupBy("doc")).applyInArrow(run, schema).persist()
    return rows.where("kind = 'block'").select("doc", "id", "order", "raw"), rows.where("kind = 'edit'").select("doc", F.col("order").alias("seq"), "error")
