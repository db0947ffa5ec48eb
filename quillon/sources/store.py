"""A store of Markdown documents as five collections with relations: docs, blocks, nodes, links, revisions.

The collections are plain tables of columns with a leading underscore; authored keys that the caller names stand beside
them without one. Relations are equalities (and ranges, for sections) that the query language turns into joins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import search
from ..plans.lower import NAMES
from ..plans.parser import Body, QueryError
from . import corpus
from .catalog import Catalog, Relation


def tables(documents: DataFrame, revisions: DataFrame | None = None, keys: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The five collections of documents (id string, path, text, deleted boolean). keys: authored front matter keys that
    become columns of docs, nested ones dotted; lists: those that become lists of texts. revisions: (doc, seq, text) or None. Deleted documents leave all but the revisions."""
    live = documents.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in documents.columns else documents
    parsed = corpus.blocks(live.select("id", "text"), "id", "text")
    paths = live.select(F.col("id").alias("_doc_id"), F.col("path").alias("_path"))
    bid = lambda doc, ordinal: F.concat(F.lit("b_"), doc, F.lit("_"), ordinal)
    order = Window.partitionBy("id").orderBy("ordinal")
    body = parsed.where(F.col("type") != "frontmatter").withColumn("_top", F.max(F.when(F.col("depth") == 0, F.col("ordinal"))).over(order))
    blocks = body.select(
        bid(F.col("id"), F.col("ordinal")).alias("_id"), F.col("id").alias("_doc_id"), F.col("type").alias("_type"), F.col("text").alias("_text"), F.col("raw").alias("_raw"), F.sha2("raw", 256).alias("_hash"),
        F.col("ordinal").alias("_ordinal"), F.col("depth").alias("_depth"), bid(F.col("id"), F.col("parent")).alias("_parent_id"), "_top", "level", "checked", F.col("above").alias("_above"),
    ).join(paths, "_doc_id")
    sections = corpus.sections(body, "id")
    title = sections.groupBy("id").agg(F.min_by("heading", "first").alias("heading"))
    wanted = tuple(dict.fromkeys(("title", *keys)))
    props = corpus.properties(parsed, "id").where((F.col("source") == "frontmatter") & F.col("name").isin(*wanted, *lists))
    first = lambda k: F.max(F.when((F.col("name") == k) & (F.col("ord") == 0), F.col("value"))).alias(f"p_{k}")
    whole = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == k, F.struct("ord", "value")))), lambda x: x["value"]).alias(f"q_{k}")
    authored = props.groupBy("id").agg(*(first(k) for k in wanted), *(whole(k) for k in lists))
    docs = live.select("id", "path", F.sha2("text", 256).alias("_hash")).join(authored, "id", "left").join(title, "id", "left")
    docs = docs.select(F.col("id").alias("_id"), F.col("path").alias("_path"), "_hash", F.coalesce("p_title", "heading", "path").alias("_title"), *(F.col(f"`p_{k}`").alias(k) for k in keys), *(F.coalesce(F.col(f"`q_{k}`"), F.array().cast("array<string>")).alias(k) for k in lists))
    node = sections.select(F.col("id").alias("_doc_id"), F.concat(F.lit("s_"), "id", F.lit("_"), "first").alias("_id"), F.lit("md:section").alias("_kind"), F.col("heading").alias("_name"), bid(F.col("id"), F.col("first")).alias("_block_id"), "level", F.col("first").alias("first_ordinal"), F.col("last").alias("last_ordinal"), F.lit(None).cast("boolean").alias("checked"))
    none = F.lit(None).cast("int")
    task = corpus.tasks(body, "id").select(F.col("id").alias("_doc_id"), F.concat(F.lit("t_"), "id", F.lit("_"), "ordinal").alias("_id"), F.lit("md:task").alias("_kind"), F.col("text").alias("_name"), bid(F.col("id"), F.col("ordinal")).alias("_block_id"), none.alias("level"), none.alias("first_ordinal"), none.alias("last_ordinal"), "checked")
    # A fragment names a place in the document that the rest leads to; an external address stays whole.
    found = corpus.links(body, "id").withColumn("_anchor", F.regexp_extract("target", "#(.*)$", 1))
    external = F.col("target").rlike("^[a-z][a-z0-9+.-]*:")
    found = found.withColumn("target", F.when(external, F.col("target")).otherwise(F.regexp_replace(F.regexp_replace("target", "#.*$", ""), "^/", "")))
    edges = corpus.resolved(found, live.select("path", "id"), "path", "id")
    nth = Window.partitionBy("id", "ordinal").orderBy("kind", "target")
    links = edges.select(
        F.concat(F.lit("e_"), "id", F.lit("_"), "ordinal", F.lit("_"), F.row_number().over(nth)).alias("_id"), F.col("id").alias("_src"), bid(F.col("id"), F.col("ordinal")).alias("_block_id"),
        F.col("kind").alias("_predicate"), F.col("dst").alias("_dst_node"), F.col("dst_kind").alias("_dst_kind"), "_anchor",
    ).join(paths.withColumnRenamed("_doc_id", "_src"), "_src")
    out = {"docs": docs, "blocks": blocks, "nodes": node.unionByName(task).join(paths, "_doc_id"), "links": links}
    if revisions is not None:
        seen = documents.select(F.col("id").alias("_doc_id"), F.col("path").alias("_path"))
        rows = revisions.select(F.concat(F.lit("r_"), "doc", F.lit("_"), "seq").alias("_id"), F.col("doc").alias("_doc_id"), F.col("seq").alias("_seq"), F.sha2("text", 256).alias("_hash"))
        last = F.row_number().over(Window.partitionBy("_doc_id").orderBy(F.col("_seq").desc())) == 1
        out["revisions"] = rows.withColumn("_is_current", last).join(seen, "_doc_id")
    return out


def references(docs: DataFrame, rows: DataFrame, key: str, held: str) -> DataFrame:
    """(key, pos, dst, path) of the documents that the texts of a list column name, by path with or without a leading
    slash, else by id; in the list's order, repeated ones kept, dangling ones dropped. One equality join over names."""
    names = docs.select(F.col("_path").alias("_name"), F.lit(0).alias("_by"), "_id", "_path").unionByName(docs.where(F.col("_id").startswith("d_")).select(F.col("_id").alias("_name"), F.lit(1).alias("_by"), "_id", "_path"))
    each = rows.select(F.col(key).alias("_k"), F.posexplode(held).alias("pos", "_t")).withColumn("_name", F.regexp_replace("_t", "^/", ""))
    best = each.join(names, "_name").groupBy("_k", "pos").agg(F.min_by(F.struct("_id", "_path"), F.struct("_by", "_id")).alias("d"))
    return best.select(F.col("_k").alias(key), "pos", F.col("d._id").alias("dst"), F.col("d._path").alias("path"))


def _to(to: str, own: str, theirs: str, consumer: str | None = None) -> Relation:
    return Relation(to, ((own, "==", theirs),), consumer)


_IN_SECTION = (("_doc_id", "==", "_doc_id"), ("first_ordinal", "<=", "_top"), ("last_ordinal", ">=", "_top"))
RELATIONS: dict[tuple[str, str], Relation] = {
    ("docs", "_blocks"): _to("blocks", "_id", "_doc_id"), ("docs", "_nodes"): _to("nodes", "_id", "_doc_id"),
    ("docs", "_out_links"): _to("links", "_id", "_src"), ("docs", "_in_links"): _to("links", "_id", "_dst_node"), ("docs", "_revisions"): _to("revisions", "_id", "_doc_id"),
    ("blocks", "_doc"): _to("docs", "_doc_id", "_id", "first"), ("blocks", "_children"): _to("blocks", "_id", "_parent_id"), ("blocks", "_nodes"): _to("nodes", "_id", "_block_id"),
    ("blocks", "_out_links"): _to("links", "_id", "_block_id"),
    ("blocks", "_section"): Relation("nodes", (("_doc_id", "==", "_doc_id"), ("_top", ">=", "first_ordinal"), ("_top", "<=", "last_ordinal"))),
    ("nodes", "_doc"): _to("docs", "_doc_id", "_id", "first"), ("nodes", "_block"): _to("blocks", "_block_id", "_id", "first"),
    ("nodes", "_blocks"): Relation("blocks", _IN_SECTION),
    ("nodes", "_subsections"): Relation("nodes", (("_doc_id", "==", "_doc_id"), ("first_ordinal", "<=", "first_ordinal"), ("last_ordinal", ">=", "last_ordinal"), ("level", "<", "level"))),
    ("links", "_doc"): _to("docs", "_src", "_id", "first"), ("links", "_dst"): _to("docs", "_dst_node", "_id", "first"), ("links", "_block"): _to("blocks", "_block_id", "_id", "first"),
    ("revisions", "_doc"): _to("docs", "_doc_id", "_id", "first"),
}
#: The columns that give each collection its order.
ORDER = {"docs": ["_path", "_id"], "blocks": ["_path", "_ordinal", "_id"], "nodes": ["_path", "_id"], "links": ["_path", "_id"], "revisions": ["_path", "_id"]}


# -- functions of the row: trees that the language lowers like any other


def _name(name: str, depth: int = 0) -> tuple:
    return ("name", depth, name)


def _all(*tests: tuple) -> tuple:
    out = tests[0]
    for t in tests[1:]:
        out = ("op", "and", out, t)
    return out


def _exists(root: str, *tests: tuple) -> tuple:
    return ("block", _name(root), "exists", Body(where=_all(*tests)))


def _only(coll: str | None, kinds: tuple[str, ...], function: str) -> None:
    if coll not in kinds:
        raise QueryError(f"{function}() is not available on {coll}")


def _literal(args: list, i: int = 0) -> str:
    if len(args) <= i or args[i][0] != "lit" or not isinstance(args[i][1], str):
        raise QueryError("a text is needed here")
    return args[i][1]


def _text(coll: str | None, args: list) -> tuple:
    _only(coll, ("docs", "blocks", "nodes"), "text")
    terms = search.parse_search(_literal(args))
    if coll == "docs":
        return _exists("blocks", ("op", "==", _name("_doc_id"), _name("_id", 1)), ("call", "text", args))
    column = "_text" if coll == "blocks" else "_name"

    def test(frame) -> Column:
        keep = F.lit(bool(terms))
        for t in terms:
            keep &= search.hits(search.tokens(F.col(frame.fields[column])), t) > 0
        return keep

    return ("host", test)


def _within(coll: str | None, args: list) -> tuple:
    _only(coll, ("blocks",), "within")
    t = _literal(args)
    if t.startswith("d_"):
        return ("op", "==", _name("_doc_id"), ("lit", t))
    if "*" in t:
        pattern = re.sub(r"([%_\\])", r"\\\1", t.lstrip("/")).replace("*", "%")
        return ("host", lambda frame: F.col(frame.fields["_path"]).like(pattern))
    return ("op", "==", _name("_path"), ("lit", t.lstrip("/")))


def _under_heading(coll: str | None, args: list) -> tuple:
    _only(coll, ("blocks",), "under_heading")
    return _exists(
        "nodes", ("op", "==", _name("_doc_id"), _name("_doc_id", 1)), ("op", "<=", _name("first_ordinal"), _name("_top", 1)), ("op", ">=", _name("last_ordinal"), _name("_top", 1)),
        ("method", ("method", _name("_name"), "lower", []), "contains", [("lit", _literal(args).lower())]),
    )


def _under(coll: str | None, args: list) -> tuple:
    """A block, and the blocks that it holds at any depth."""
    _only(coll, ("blocks",), "under")
    target = F.lit(_literal(args))

    def test(frame) -> Column:
        doc = F.col(frame.fields["_doc_id"])
        return (F.col(frame.fields["_id"]) == target) | F.exists(F.col(frame.fields["_above"]), lambda a: F.concat(F.lit("b_"), doc, F.lit("_"), a["ordinal"]) == target)

    return ("host", test)


def _under_kind(coll: str | None, args: list) -> tuple:
    """Blocks that a block of a type holds, at any depth, with a text in it if there is one."""
    _only(coll, ("blocks",), "under_kind")
    kind, text = _literal(args), _literal(args, 1) if len(args) > 1 else ""
    return ("host", lambda frame: F.exists(F.col(frame.fields["_above"]), lambda a: (a["type"] == kind) & F.contains(a["text"], F.lit(text))))


def _has_edge(coll: str | None, args: list) -> tuple:
    _only(coll, ("docs", "blocks"), "has_edge")
    tests = [("op", "==", _name("_src" if coll == "docs" else "_block_id"), _name("_id", 1)), ("op", "==", _name("_predicate"), args[0])]
    return _exists("links", *tests, *([("op", "==", _name("_dst_node"), args[1])] if len(args) > 1 else []))


def _has_anchor(coll: str | None, args: list) -> tuple:
    _only(coll, ("blocks",), "has_anchor")
    return _exists("links", ("op", "==", _name("_block_id"), _name("_id", 1)), ("op", "!=", _name("_anchor"), ("lit", "")))


def _child_count(coll: str | None, args: list) -> tuple:
    _only(coll, ("blocks",), "child_count")
    return ("block", _name("blocks"), "count", Body(where=("op", "==", _name("_parent_id"), _name("_id", 1))))


def _parent_type(coll: str | None, args: list) -> tuple:
    _only(coll, ("blocks",), "parent_type")
    return ("block", _name("blocks"), "first", Body(select=[(None, 0, _name("_type"))], values=True, where=("op", "==", _name("_id"), _name("_parent_id", 1))))


def _semantic(vectors: dict[str, tuple[str, list[float]]]):
    """semantic("phrase"): cosine of the row's `_vector` with the phrase's, which the caller embedded."""

    def score(coll: str | None, args: list) -> tuple:
        _only(coll, ("docs", "blocks"), "semantic")
        phrase = _literal(args)
        if phrase not in vectors:
            raise QueryError("no vector was given for this phrase")
        q = F.array(*(F.lit(float(x)) for x in vectors[phrase]))
        return ("host", lambda frame: search.cosine(F.col(frame.fields["_vector"]), q))

    return score


MACROS = {"text": _text, "within": _within, "under": _under, "under_heading": _under_heading, "under_kind": _under_kind, "has_edge": _has_edge, "has_anchor": _has_anchor, "child_count": _child_count, "parent_type": _parent_type}


def catalog(collections: dict[str, DataFrame], phrases: dict[str, list[float]] | None = None) -> Catalog:
    """A catalog of the store's collections with their order, relations and functions. phrases: vectors of the phrases
    that semantic() may name; rows need a `_vector` then."""
    out = Catalog(relations=dict(RELATIONS), macros=dict(MACROS) | {"semantic": _semantic(phrases or {})})
    for name, df in collections.items():
        out.add(name, df, ORDER[name])
    if "docs" in collections:
        docs = collections["docs"]
        names = F.array(F.col("_path"), F.concat(F.lit("/"), "_path"), F.when(F.col("_id").startswith("d_"), F.col("_id")))
        out.add(NAMES, docs.withColumn("_name", F.explode(F.array_compact(names))), ["_path", "_id"])
    return out
