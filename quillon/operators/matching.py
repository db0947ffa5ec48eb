"""Keeping block identity across versions: which block of a new version is which block of the old one.

Equal texts match first, in order; then texts equal up to white space and case; then the most similar pairs at or above
a threshold, best first. Equal texts are matched by joins on (document, text, occurrence). What is left, the changed
blocks, is compared within its document in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .search import similar_pairs

#: Similarity from which a changed block keeps its identity, and how far below it pairs are reported.
THRESHOLD, NEAR = 0.6, 0.1


def shingle_set(text: str) -> set[tuple[str, ...]]:
    toks = text.lower().split()
    return {tuple(toks[i : i + 3]) for i in range(len(toks) - 2)} if len(toks) > 2 else {tuple(toks)} if toks else set()


def text_sim(a: str, b: str) -> float:
    """1 for equal texts, else the Dice similarity of their three-token shingles."""
    if a == b:
        return 1.0
    x, y = shingle_set(a), shingle_set(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def _equal(old: DataFrame, new: DataFrame, form: Column, method: str) -> DataFrame:
    def numbered(df: DataFrame, name: str) -> DataFrame:
        h = F.sha2(form, 256)
        w = Window.partitionBy("doc", "_h").orderBy("ordinal")
        return df.withColumn("_h", h).select("doc", "_h", F.row_number().over(w).alias("_n"), F.col("id").alias(name))

    return numbered(old, "old_id").join(numbered(new, "new_id"), ["doc", "_h", "_n"]).select("doc", "old_id", "new_id", F.lit(method).alias("method"), F.lit(1.0).alias("similarity"))


def match_blocks(old: DataFrame, new: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, old_id, new_id, method, similarity) of two tables (doc, id, ordinal, text). method: exact, normalised,
    scored, deleted (no new_id), inserted (no old_id), near (a pair just below the threshold, as evidence; its blocks
    have a deleted and an inserted row too). Null texts are empty; ids are strings."""
    old, new = (df.select(F.col("doc").alias("doc"), F.col("id").cast("string").alias("id"), F.col("ordinal").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text")) for df in (old, new))
    matched = None
    left, right = old, new
    for method, form in (("exact", F.col("text")), ("normalised", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))):
        found = _equal(left, right, form, method).persist()
        matched = found if matched is None else matched.unionByName(found)
        left = left.join(found.select("doc", F.col("old_id").alias("id")), ["doc", "id"], "left_anti")
        right = right.join(found.select("doc", F.col("new_id").alias("id")), ["doc", "id"], "left_anti")
    schema = T.StructType([T.StructField("doc", old.schema["doc"].dataType), *T.StructType.fromDDL("old_id string, new_id string, method string, similarity double").fields])

    arrow = to_arrow_schema(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        d = (a if a.num_rows else b)["doc"][0].as_py()
        ao, bo = a["ordinal"].to_pylist(), b["ordinal"].to_pylist()
        by: dict[tuple, list[int]] = {}
        sets = [shingle_set(t) for t in b["text"].to_pylist()]
        for j, s in enumerate(sets):
            for x in s:
                by.setdefault(x, []).append(j)
        pairs = []
        for i, t in enumerate(a["text"].to_pylist()):
            mine, shared = shingle_set(t), {}
            for x in mine:
                for j in by.get(x, ()):
                    shared[j] = shared.get(j, 0) + 1
            pairs += [(-2 * n / (len(mine) + len(sets[j])), abs(ao[i] - bo[j]), i, j) for j, n in shared.items()]
        ai, bi, out, used_a, used_b = a["id"].to_pylist(), b["id"].to_pylist(), [], set(), set()
        for s, _, i, j in sorted(pairs):
            if i in used_a or j in used_b:
                continue
            if -s >= threshold:
                used_a.add(i)
                used_b.add(j)
                out.append((d, ai[i], bi[j], "scored", -s))
            elif -s >= threshold - NEAR:
                out.append((d, ai[i], bi[j], "near", -s))
        out += [(d, x, None, "deleted", None) for i, x in enumerate(ai) if i not in used_a]
        out += [(d, None, x, "inserted", None) for j, x in enumerate(bi) if j not in used_b]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    rest = left.groupBy("doc").cogroup(right.groupBy("doc")).applyInArrow(run, schema)
    return matched.unionByName(rest)


def moves(deleted: DataFrame, inserted: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(from_doc, to_doc, carried_id, replaced_id, kind, confidence): blocks (doc, id, position, type, text) that went from
    one document to another. The most similar pairs first, then by positions; each block once. Candidates come from the
    shingle join; rounds then take every pair that is the best one left for both of its blocks, which is what taking
    them one by one gives."""
    a = deleted.select(F.concat_ws("/", "doc", "id").alias("_o"), F.col("doc").alias("from_doc"), F.col("id").alias("carried_id"), F.col("position").alias("_po"), F.col("type").alias("_to"), F.coalesce("text", F.lit("")).alias("_texto"))
    b = inserted.select(F.concat_ws("/", "doc", "id").alias("_i"), F.col("doc").alias("to_doc"), F.col("id").alias("replaced_id"), F.col("position").alias("_pi"), F.col("type").alias("_ti"), F.coalesce("text", F.lit("")).alias("_texti"))
    near = similar_pairs(a.select("_o", F.col("_texto").alias("text")), b.select("_i", F.col("_texti").alias("text")), "_o", "_i", "text", threshold)
    size = lambda c: F.greatest(F.size(F.filter(F.split(c, r"\s+"), lambda t: t != "")), F.lit(1))
    pairs = near.join(a, "_o").join(b, "_i").where((F.col("_to") == F.col("_ti")) & (F.col("from_doc") != F.col("to_doc")))
    pairs = pairs.where(F.greatest(size("_texto") / size("_texti"), size("_texti") / size("_texto")) <= 3)
    same = F.col("_texto") == F.col("_texti")
    pairs = pairs.withColumn("confidence", F.when(same, 1.0).otherwise(F.col("similarity"))).withColumn("kind", F.when(same, "moved").otherwise("edited_moved"))
    pairs = pairs.select("_o", "_i", "_po", "_pi", "from_doc", "to_doc", "carried_id", "replaced_id", "kind", "confidence").persist()
    out = None
    while not pairs.isEmpty():
        order = [F.col("confidence").desc(), "_po", "_pi", "_o", "_i"]
        best = pairs.withColumn("_x", F.row_number().over(Window.partitionBy("_o").orderBy(*order))).withColumn("_y", F.row_number().over(Window.partitionBy("_i").orderBy(*order)))
        taken = best.where("_x = 1 and _y = 1").drop("_x", "_y").persist()
        out = taken if out is None else out.unionByName(taken)
        pairs = pairs.join(taken.select("_o"), "_o", "left_anti").join(taken.select("_i"), "_i", "left_anti").persist()
    out = pairs if out is None else out
    return out.select("from_doc", "to_doc", "carried_id", "replaced_id", "kind", "confidence")
