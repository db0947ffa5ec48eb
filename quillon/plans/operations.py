"""Registered queries of the operators beside the query language, each with its DuckDB form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import MARKED, PLAIN, sql_stem
from ..operators import history, search, walk
from ..operators.edits import apply_edits
from ..operators.matching import match_blocks
from ..sources import corpus
from ..streaming import feed
from . import dql
from .catalogue import tables
from .lower import execute


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TOKENS = f"list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{MARKED}', '{PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
#: (doc_id, t): the stems of every document; each distinct word is cut once.
_STEMS = f"""(WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS x FROM documents), k AS (SELECT x, {sql_stem("x")} AS y FROM (SELECT DISTINCT x FROM w))
SELECT doc_id, coalesce(t, []) AS t FROM documents LEFT JOIN (SELECT doc_id, list(y) AS t FROM w JOIN k USING (x) GROUP BY 1) USING (doc_id))"""


def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_filter(_read(spark, sf_dir, "documents"), "text", "the er*").select("doc_id")


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_read(spark, sf_dir, "documents"), "doc_id", "text", "er and", 20).select("doc_id", F.round("score", 6).alias("score"), "rank")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_read(spark, sf_dir, "documents"), "doc_id", "text")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return search.vector_search(e, "vec_id", "embedding", q, 10).select("vec_id", F.round("cosine", 6).alias("cosine"), "rank")


def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    vectors = search.vector_search(e, "vec_id", "embedding", q, 200).select(F.col("vec_id").alias("doc_id"), "rank")
    texts = search.bm25(_read(spark, sf_dir, "documents"), "doc_id", "text", "er and", 200)
    return search.fuse(texts, vectors, "doc_id", 50).select("doc_id", F.round("score", 9).alias("score"))


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _read(spark, sf_dir, "benchmark").select("item_id", "text")
    b = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg"), "text")
    pairs = search.similar_pairs(a.unionByName(b.select((-F.col("msg") - 1).alias("item_id"), "text")), b, "item_id", "msg", "text", 0.8)
    return pairs.select("item_id", "msg", F.round("similarity", 6).alias("similarity"))


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.pooled(_read(spark, sf_dir, "embeddings").withColumn("w", F.col("vec_id") % 3 + 1), "label", "embedding", "w")
    return out.select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), "role", "text")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.numbered(_revisions(spark, sf_dir), "doc", "seq").select("doc", "seq", "version", "previous")


def read_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.read_at(_revisions(spark, sf_dir), "doc", "seq", 1).select("doc", "seq", "text")


def block_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _revisions(spark, sf_dir)
    return history.diff(history.read_at(r, "doc", "seq", 0), history.read_at(r.where("doc % 3 <> 0 or seq <> 0"), "doc", "seq", 2), ["doc"], "text").select("doc", "change")


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _revisions(spark, sf_dir)
    a = history.read_at(r, "doc", "seq", 0).select("doc", F.col("text").alias("before"))
    return history.unified_diff(a.join(history.read_at(r, "doc", "seq").select("doc", F.col("text").alias("after")), "doc"), "doc", "before", "after")


def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changes_since(_read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 40, 25, ("event_type", "purchase"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return history.retention(e, "user_id", "event_id", "ts", "2024-02-15 00:00:00", history.Policy(5, 2, ((5, "day"), (20, "week")))).select("user_id", "event_id", "kept")


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.unreachable(_read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", _read(spark, sf_dir, "lineitem").where("l_quantity > 49"), "l_partkey")


def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"), F.lit("holds").alias("predicate"))
    return walk.neighbourhood(links, [1], 2, "both")[0]


def nearest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"), F.lit("holds").alias("predicate"))
    return walk.neighbourhood(links, [1], 2, "both", "holds", 12)[0]


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.blocks(_read(spark, sf_dir, "documents"), "doc_id", "text")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.html_links(_read(spark, sf_dir, "pages"), "page_id", "html")


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.edge_counts(page_links(spark, sf_dir).withColumn("predicate", F.lit("links")), "predicate", "href")


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.page(_read(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"], ("a", 0), 50)


def observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _revisions(spark, sf_dir)
    known = history.read_at(r, "doc", "seq", 0).where("doc % 4 <> 0").select("doc", F.sha2("text", 256).alias("hash"))
    return feed.observe(known, r.where("seq <= doc % 3"), "doc").select("doc", "kind")


def rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _revisions(spark, sf_dir)
    at = lambda n: history.read_at(r, "doc", "seq", n).select("doc", F.sha2("text", 256).alias("hash"))
    return feed.rescan(at(0).where("doc % 4 <> 0"), at(1).where("doc % 5 <> 0"), "doc")


def block_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _revisions(spark, sf_dir).select("doc", F.col("seq").cast("string").alias("id"), F.col("seq").alias("ordinal"), "text")
    new = r.where("doc % 3 <> 0 or ordinal <> 1").withColumn("ordinal", F.col("ordinal") + F.col("doc") % 2)
    return match_blocks(r, new).select("doc", "old_id", "new_id", "method")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _revisions(spark, sf_dir).select("doc", F.col("seq").cast("string").alias("id"), F.col("seq").alias("order"), F.col("text").alias("raw"))
    one = r.where("order = 0").select("doc", F.lit(1).alias("seq"), F.lit("remove").alias("op"), "id", F.lit(None).cast("string").alias("raw"))
    two = r.where("order = 1").select("doc", F.lit(2).alias("seq"), F.lit("update").alias("op"), "id", F.lit("changed").alias("raw"))
    return apply_edits(r, one.unionByName(two))[0].select("doc", "id", "order", "raw")


#: Texts of the second dialect with the DuckDB form.
DQL: dict[str, tuple[str, str]] = {
    "dql_table": ('TABLE lang, length(text) AS n WHERE n_chars > 500 AND contains(lang, "e") SORT n_chars DESC, doc_id LIMIT 30', "SELECT doc_id AS \"File\", lang, length(text)::INT AS n FROM documents WHERE n_chars > 500 AND contains(lang, 'e') ORDER BY n_chars DESC, doc_id LIMIT 30"),
    "dql_group": ("TABLE length(rows) AS n, max(rows.n_chars) AS m WHERE n_chars > 100 GROUP BY lang AS l SORT l", "SELECT lang AS l, count(*) AS n, max(n_chars) AS m FROM documents WHERE n_chars > 100 GROUP BY 1"),
    "dql_list": ('LIST WITHOUT ID upper(lang) WHERE startswith(lang, "e") OR regextest("^d", lang)', "SELECT upper(lang) AS \"upper(lang)\" FROM documents WHERE starts_with(lang, 'e') OR regexp_matches(lang, '^d')"),
}


def _dql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    names = dql.Mapping_(pages="documents", path="doc_id", fields={"path": "doc_id", "name": "doc_id"})
    return lambda spark, sf_dir: execute(tables(spark, sf_dir), dql.translate(text, names).tree)


_RANKED = """WITH d AS (SELECT doc_id, t FROM {stems}), c AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'er')) AS a, len(list_filter(t, lambda x: x = 'and')) AS b FROM d),
s AS (SELECT count(*) AS m, avg(n) AS g, count(*) FILTER (a > 0) AS x, count(*) FILTER (b > 0) AS y FROM c),
r AS (SELECT doc_id, greatest(ln((m - x + 0.5) / (x + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / g)) + greatest(ln((m - y + 0.5) / (y + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / g)) AS score FROM c, s WHERE a > 0 AND b > 0)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r""".format(stems=_STEMS)
_COSINE = "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, coalesce(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 0) AS cosine, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings, q"
_SETS = "SELECT id, list_distinct(CASE WHEN len(t) > 2 THEN list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS s FROM (SELECT id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS t FROM ({src}))"
_MSG = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"

#: name: (query, SQL or None)
OPERATIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "text_filter": (text_filter, f"SELECT doc_id FROM {_STEMS} WHERE list_contains(t, 'the') AND len(list_filter(t, lambda x: starts_with(x, 'er'))) > 0"),
    "bm25": (bm25, f"SELECT doc_id, round(score, 6) AS score, rank::INT AS rank FROM ({_RANKED}) WHERE rank <= 20"),
    "postings": (postings, f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM {_STEMS}) GROUP BY ALL"),
    "vector_topk": (vector_topk, f"SELECT vec_id, round(cosine, 6) AS cosine, rank::INT AS rank FROM ({_COSINE}) WHERE rank <= 10"),
    "rrf": (rrf, f"SELECT doc_id, round(coalesce(1 / (60 + t.rank), 0) + coalesce(1 / (60 + v.rank), 0), 9) AS score FROM (SELECT * FROM ({_RANKED}) WHERE rank <= 200) t FULL JOIN (SELECT vec_id AS doc_id, rank FROM ({_COSINE}) WHERE rank <= 200) v USING (doc_id) ORDER BY coalesce(1 / (60 + t.rank), 0) + coalesce(1 / (60 + v.rank), 0) DESC, doc_id LIMIT 50"),
    "near_pairs": (near_pairs, "WITH b AS (" + _SETS.replace("{src}", _MSG) + "), a AS (" + _SETS.replace("{src}", "SELECT item_id AS id, text FROM benchmark UNION ALL SELECT -id - 1, text FROM (" + _MSG + ")") + ") SELECT a.id AS item_id, b.id AS msg, round(2 * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s)), 6) AS similarity FROM a, b WHERE len(a.s) > 0 AND len(b.s) > 0 AND 2 * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s)) >= 0.8"),
    "doc_vectors": (doc_vectors, "WITH m AS (SELECT label, i, sum(embedding[i]::DOUBLE * (vec_id % 3 + 1)) / sum(vec_id % 3 + 1) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i) GROUP BY ALL), v AS (SELECT label, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT label, list_transform(v, lambda x: round(x / n, 6)) AS vector FROM v"),
    "versions": (versions, "SELECT conv_id AS doc, turn AS seq, (row_number() OVER w)::INT AS version, lag(turn) OVER w AS previous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "read_at": (read_at, "SELECT conv_id AS doc, max(turn) AS seq, arg_max(text, turn) AS text FROM conversations WHERE turn <= 1 GROUP BY 1"),
    "block_diff": (block_diff, "WITH a AS (SELECT conv_id AS doc, text FROM conversations WHERE turn = 0), b AS (SELECT conv_id AS doc, arg_max(text, turn) AS text FROM conversations WHERE turn <= 2 AND (conv_id % 3 <> 0 OR turn <> 0) GROUP BY 1) SELECT doc, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc) WHERE a.text IS DISTINCT FROM b.text"),
    "unified_diff": (unified, None),
    "feed_page": (feed_page, "WITH p AS (SELECT event_id, event_type FROM events WHERE event_id > 40 AND event_type = 'purchase' ORDER BY event_id LIMIT 26) SELECT event_id, event_type, (SELECT count(*) FROM p) > 25 AS truncated FROM p ORDER BY event_id LIMIT 25"),
    "retention": (retention, "WITH a AS (SELECT user_id, event_id, ts, floor((epoch_ms(TIMESTAMP '2024-02-15') - epoch_ms(ts)) / 86400000) AS age FROM events), g AS (SELECT *, CASE WHEN age >= 20 THEN 1 WHEN age >= 5 THEN 0 ELSE -1 END AS rung, CASE WHEN age >= 20 THEN date_trunc('week', ts) WHEN age >= 5 THEN date_trunc('day', ts) END AS p FROM a) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2 OR age < 5 OR rung < 0 OR row_number() OVER (PARTITION BY user_id, rung, p ORDER BY event_id DESC) = 1 AS kept FROM g"),
    "sweep": (sweep, "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)"),
    "neighbourhood": (neighbourhood, "WITH e AS (SELECT l_orderkey AS o, -l_partkey - 1 AS p FROM lineitem), n1 AS (SELECT DISTINCT p FROM e WHERE o = 1), n2 AS (SELECT DISTINCT o FROM e JOIN n1 USING (p) WHERE o <> 1) SELECT 1 AS key, 0 AS distance UNION ALL SELECT p, 1 FROM n1 UNION ALL SELECT o, 2 FROM n2"),
    "nearest_documents": (nearest_documents, "WITH e AS (SELECT l_orderkey AS o, -l_partkey - 1 AS p FROM lineitem), n1 AS (SELECT DISTINCT p FROM e WHERE o = 1), n2 AS (SELECT DISTINCT o FROM e JOIN n1 USING (p) WHERE o <> 1) SELECT key, distance FROM (SELECT 1 AS key, 0 AS distance UNION ALL SELECT p, 1 FROM n1 UNION ALL SELECT o, 2 FROM n2) ORDER BY distance, key LIMIT 12"),
    "doc_blocks": (doc_blocks, None),
    "page_links": (page_links, "SELECT page_id, (i - 1)::INT AS ord, l[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1) AS l FROM pages), unnest(range(1, len(l) + 1)) AS t(i)"),
    "link_counts": (link_counts, "SELECT 'links' AS predicate, href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 2"),
    "keyset_page": (keyset_page, "SELECT source, doc_id FROM documents WHERE (source, doc_id) > ('a', 0) ORDER BY source, doc_id LIMIT 50"),
    "observe": (observe, "WITH k AS (SELECT conv_id AS doc, text FROM conversations WHERE turn = 0 AND conv_id % 4 <> 0), b AS (SELECT conv_id AS doc, arg_max(text, turn) AS text FROM conversations WHERE turn <= conv_id % 3 GROUP BY 1) SELECT doc, CASE WHEN k.text IS NULL THEN 'create' ELSE 'update' END AS kind FROM b LEFT JOIN k USING (doc) WHERE k.text IS DISTINCT FROM b.text"),
    "rescan": (rescan, "WITH a AS (SELECT conv_id AS doc, text FROM conversations WHERE turn = 0 AND conv_id % 4 <> 0), b AS (SELECT conv_id AS doc, arg_max(text, turn) AS text FROM conversations WHERE turn <= 1 AND conv_id % 5 <> 0 GROUP BY 1) SELECT doc, CASE WHEN a.text IS NULL THEN 'create' WHEN b.text IS NULL THEN 'delete' ELSE 'update' END AS kind FROM a FULL JOIN b USING (doc) WHERE a.text IS DISTINCT FROM b.text"),
    "block_match": (block_match, None),
    "edits": (edits, "SELECT conv_id AS doc, turn::VARCHAR AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS \"order\", CASE WHEN turn = 1 THEN 'changed' ELSE text END AS raw FROM conversations WHERE turn <> 0"),
    **{n: (_dql(t), s) for n, (t, s) in DQL.items()},
}

QUERIES = {n: f for n, (f, _) in OPERATIONS.items()}
ORACLE_SQL = {n: s for n, (_, s) in OPERATIONS.items() if s is not None}
