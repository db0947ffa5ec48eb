"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity as tox
from . import warc
from .decontaminate import contaminated
from .flac import flac_column, media_digests
from .line_dedup import line_dedup
from .ngram_join import ngram_components
from .packing import pack
from .pitman_yor import language_model_scores
from .spark_util import table
from .substring_dedup import substring_dedup
from .token_counts import token_counts

WORD_BPE = "word_bpe_49k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), 20).drop("ranges")


def _replica(pages: DataFrame) -> DataFrame:
    """A copy of the pages with known damage: about a hundredth each of the bodies has its first character replaced, is
    cut in half, and is lost."""
    fold = F.pmod("page_id", F.lit(101))
    body = F.when(fold == 7, F.expr("concat('#', substr(html, 2))")).when(fold == 23, F.expr("substr(html, 1, length(html) div 2)")).otherwise(F.col("html"))
    return pages.where(F.coalesce(fold != 11, F.lit(True))).withColumn("html", body)


def op2_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    lost = F.coalesce(F.pmod("page_id", F.lit(101)) == 31, F.lit(False))
    return warc.audit(warc.records(pages.where(~lost)), warc.records(_replica(pages)))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), 2048, 1, cache=1_500_000)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), 3, 20)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5, 0.8)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), 4, 85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = tox.train(docs, table(spark, sf_dir, "labels"), fold != 2)
    top = F.array_max(F.transform("passages", lambda x: F.struct(x["score"].alias("score"), (-x["start"]).alias("back"), x["words"].alias("words"))))
    return tox.toxicity(docs, model, 0.3).select("doc_id", (fold == 2).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"), (-top["back"]).alias("passage_start"), top["words"].alias("passage_words"), top["score"].alias("passage_score"))


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(flac_column(table(spark, sf_dir, "documents"), "doc_id", "text", 64))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), 2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc_audit": op2_warc_audit,
    "op3_language_model": op3_language_model,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_flac": op9_flac,
    "op10_token_counts": op10_token_counts,
}
#: A document's text as lines, keys stripped of the separators and lower-cased (A-Z only).
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH d AS (
  SELECT doc_id, {_WORDS.format("text")} AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM s
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE nth > 1
), w AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), m AS (
  SELECT w.doc_id, w.word, w.p, gone.p IS NOT NULL AS hit FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p
), r AS (
  SELECT doc_id, count(*) FILTER (WHERE hit) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT hit) AS kept FROM m GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
""",
    "op2_warc_audit": """
WITH r AS (
  SELECT page_id, url, html, page_id % 101 <> 31 AS in_a, page_id % 101 <> 11 AS in_b,
    CASE page_id % 101 WHEN 7 THEN '#' || substr(html, 2) WHEN 23 THEN substr(html, 1, length(html) // 2) ELSE html END AS damaged FROM pages
), t AS (
  SELECT page_id, in_a, in_b,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, damaged FROM r
), u AS (
  SELECT page_id, CASE WHEN in_a THEN head || strlen(html) || gap || html || gap END AS a, CASE WHEN in_b THEN head || strlen(damaged) || gap || damaged || gap END AS b FROM t
), h AS (
  SELECT page_id, strlen(a) AS length_a, strlen(b) AS length_b, sha256(a) AS sha_a, sha256(b) AS sha_b, page_id >> 8 AS warc_file,
    coalesce(sum(strlen(a)) OVER (PARTITION BY page_id >> 8 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM u
)
SELECT page_id, CASE WHEN sha_b IS NULL THEN 'missing' WHEN sha_a IS NULL THEN 'extra' ELSE 'changed' END AS fault, warc_file,
  CASE WHEN sha_a IS NOT NULL THEN before END AS record_offset, length_a, length_b, sha_a, sha_b
FROM h WHERE sha_a IS DISTINCT FROM sha_b
""",
    "op7_ngram_join": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair WHERE 100 * shared >= 85 * (na + nb - shared)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, edge.b FROM reach r JOIN edge ON edge.a = r.other
)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.other) AS component_id FROM s JOIN reach r ON r.doc_id = s.doc_id GROUP BY ALL
""",
    "op5_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l
), g AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, g.key IS NULL OR g.keeper = k.doc_id AS stays FROM k LEFT JOIN g ON g.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
