"""Registered queries over a store of Markdown documents, and of the operators around it, with their DuckDB forms.

The store's documents are written from all conversations: a talk a document, with front matter, a heading and a paragraph
for each turn, nested tasks and links. Their shape is known, so SQL over conversations says what every query gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history, search, writes
from ..operators.edits import apply_edits
from ..sources import corpus, mapping, store
from ..sources.catalog import Catalog
from ..streaming import feed
from .lower import execute


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, text) of every conversation as a Markdown document."""
    said = F.concat(F.lit("Said "), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+", " ")))
    part = F.concat(F.lit("## Turn "), "turn", F.lit(" "), "role", F.lit("\n\n"), said, F.lit("\n\n"))
    rows = _read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("c")).agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    layer = F.element_at(F.array(F.lit("canon"), F.lit("working"), F.lit("draft")), (F.col("c") % 3 + 1).cast("int"))
    text = F.concat(
        F.lit("---\ntitle: Talk "), "c", F.lit("\nlayer: "), layer, F.lit("\n---\n\n# Talk "), "c", F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["part"]), ""),
        F.lit("## Tasks\n\n- [x] check "), "c", F.lit("\n  - [ ] send "), "c", F.lit("\n\n## Links\n\nSee [next](talks/"), F.col("c") + 1, F.lit(".md) and [site](https://example.org/"), F.col("c") % 5, F.lit(") and [[talks/0.md|zero]].\n"),
    )
    return rows.select(F.concat(F.lit("d_"), "c").alias("id"), F.concat(F.lit("talks/"), "c", F.lit(".md")).alias("path"), text.alias("text"))


def _store(spark: SparkSession, sf_dir: str) -> Catalog:
    versions = _read(spark, sf_dir, "conversations").select(F.concat(F.lit("d_"), "conv_id").alias("doc"), F.col("turn").alias("seq"), "text")
    return store.catalog(store.tables(talks(spark, sf_dir), versions, ("layer",)))


_T = """t AS (SELECT conv_id AS c, turn, role, 'Said ' || trim(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
d AS (SELECT c, count(*) AS n, 'd_' || c AS id, 'talks/' || c || '.md' AS path, 'Talk ' || c AS title, CASE c % 3 WHEN 0 THEN 'canon' WHEN 1 THEN 'working' ELSE 'draft' END AS layer FROM t GROUP BY c),
b AS (SELECT c, 1 AS o, 'heading' AS type, title AS text, 1 AS level FROM d UNION ALL SELECT c, 2 + 2 * i, 'heading', 'Turn ' || turn || ' ' || role, 2 FROM t UNION ALL SELECT c, 3 + 2 * i, 'paragraph', said, NULL FROM t
  UNION ALL SELECT c, 2 * n + 2, 'heading', 'Tasks', 2 FROM d UNION ALL SELECT c, 2 * n + 3, 'task', 'check ' || c, NULL FROM d UNION ALL SELECT c, 2 * n + 4, 'task', 'send ' || c, NULL FROM d UNION ALL SELECT c, 2 * n + 5, 'heading', 'Links', 2 FROM d
  UNION ALL SELECT c, 2 * n + 6, 'paragraph', 'See [next](talks/' || (c + 1) || '.md) and [site](https://example.org/' || (c % 5) || ') and [[talks/0.md|zero]].', NULL FROM d),
s AS (SELECT c, o, text, level, CASE WHEN level = 1 THEN 2 * n + 6 ELSE coalesce(lead(o) OVER (PARTITION BY c, level ORDER BY o) - 1, 2 * n + 6) END AS last FROM b JOIN d USING (c) WHERE type = 'heading'),
e AS (SELECT id AS src, c, 2 * n + 6 AS o, CASE WHEN EXISTS (SELECT 1 FROM d x WHERE x.c = d.c + 1) THEN 'd_' || (c + 1) ELSE 'phantom:talks/' || (c + 1) || '.md' END AS dst, 'md:link' AS predicate FROM d
  UNION ALL SELECT id, c, 2 * n + 6, 'https://example.org/' || (c % 5), 'md:link' FROM d UNION ALL SELECT id, c, 2 * n + 6, CASE WHEN EXISTS (SELECT 1 FROM d WHERE c = 0) THEN 'd_0' ELSE 'phantom:talks/0.md' END, 'md:wikilink' FROM d)"""
_ID = "'b_d_' || c || '_' || o"

#: name: (query over the store, SQL after its common tables)
STORE: dict[str, tuple[str, str]] = {
    "store_docs": ("docs { _id, _path, _title, layer }", "SELECT id AS _id, path AS _path, title AS _title, layer FROM d"),
    "store_order": ("docs { _path limit 12 offset 3 }", "SELECT path AS _path FROM d ORDER BY path LIMIT 12 OFFSET 3"),
    "store_blocks": ("blocks { _id, _type, _text, _ordinal, level }", f"SELECT {_ID} AS _id, type AS _type, text AS _text, o AS _ordinal, level FROM b"),
    "store_sections": ('nodes { _doc_id, _name, level, first_ordinal, last_ordinal where _kind == "md:section" }', "SELECT 'd_' || c AS _doc_id, text AS _name, level, o AS first_ordinal, last AS last_ordinal FROM s"),
    "store_links": ("links { _src, _predicate, _dst_node, _dst_kind }", "SELECT src AS _src, predicate AS _predicate, dst AS _dst_node, CASE WHEN dst LIKE 'https:%' THEN 'external' WHEN dst LIKE 'phantom:%' THEN 'phantom' ELSE 'doc' END AS _dst_kind FROM e"),
    "store_revisions": ("revisions { _doc_id, _seq, _is_current }", "SELECT 'd_' || c AS _doc_id, turn AS _seq, turn = max(turn) OVER (PARTITION BY c) AS _is_current FROM t"),
    "fk_reach": ('blocks { _id, t: _doc._title, l: _doc.layer, d: _doc._id where _type == "task" }', f"SELECT {_ID} AS _id, title AS t, layer AS l, id AS d FROM b JOIN d USING (c) WHERE type = 'task'"),
    "fk_filter": ('links { _src, _dst_node where _dst.layer == "canon" and _doc.layer != "canon" }', "SELECT src AS _src, dst AS _dst_node FROM e JOIN d x ON x.id = e.dst JOIN d y ON y.c = e.c WHERE x.layer = 'canon' AND y.layer <> 'canon'"),
    "fk_dangling": ('links { _src where _dst == null and _predicate == "md:link" }', "SELECT src AS _src FROM e WHERE predicate = 'md:link' AND dst NOT IN (SELECT id FROM d)"),
    "relation_counts": ('docs { _id, n: _blocks count { where _type == "paragraph" }, o: _out_links count { }, i: _in_links count { } }', "SELECT id AS _id, n + 1 AS n, 3 AS o, (SELECT count(*) FROM e WHERE dst = d.id) AS i FROM d"),
    "relation_lists": ('docs { _id, h: _blocks { _text values where level == 2 } }', "SELECT id AS _id, list(text ORDER BY o) AS h FROM b JOIN d USING (c) WHERE level = 2 GROUP BY id"),
    "relation_tests": ('docs { _id where _in_links exists { where _predicate == "md:link" } and _revisions count { } > 4 }', "SELECT id AS _id FROM d WHERE EXISTS (SELECT 1 FROM e WHERE dst = d.id AND predicate = 'md:link') AND n > 4"),
    "relation_flatten": ("docs { _id, l._dst_node flatten _out_links as l }", "SELECT src AS _id, dst AS _dst_node FROM e"),
    "relation_from": ("docs { select _predicate, _dst_node from _out_links }", "SELECT predicate AS _predicate, dst AS _dst_node FROM e"),
    "section_blocks": ('nodes { _id, n: _blocks count { } where _kind == "md:section" }', "SELECT 's_d_' || c || '_' || o AS _id, last - o + 1 AS n FROM s"),
    "subsections": ("nodes { _id, n: _subsections count { } where level == 1 }", "SELECT 's_d_' || c || '_1' AS _id, n + 2 AS n FROM d"),
    "block_sections": ('blocks { _id, s: _section { _name values } where _type == "paragraph" }', f"SELECT 'b_d_' || b.c || '_' || b.o AS _id, list(s.text ORDER BY 's_d_' || s.c || '_' || s.o) AS s FROM b JOIN s ON s.c = b.c AND b.o BETWEEN s.o AND s.last WHERE type = 'paragraph' GROUP BY b.c, b.o"),
    "under_heading": ('blocks { _id where under_heading("turn 1 ") }', f"SELECT {_ID} AS _id FROM (SELECT DISTINCT b.c, b.o FROM b JOIN s ON s.c = b.c AND b.o BETWEEN s.o AND s.last WHERE lower(s.text) LIKE '%turn 1 %')"),
    "text_blocks": ('blocks { _id where text("said die") }', f"SELECT {_ID} AS _id FROM b WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), 'said') AND list_contains(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), 'die')"),
    "text_docs": ('docs { _id where text("die unge*") and not text("zzzz") }', "SELECT DISTINCT 'd_' || c AS _id FROM b WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'die') AND len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'ung'))) > 0"),
    "has_edge": ('docs { _id where has_edge("md:link", "https://example.org/2") and has_edge("md:wikilink") }', "SELECT id AS _id FROM d WHERE c % 5 = 2"),
    "within": ('blocks { _id where within("talks/1*.md") and _type == "task" }', f"SELECT {_ID} AS _id FROM b JOIN d USING (c) WHERE path LIKE 'talks/1%.md' AND type = 'task'"),
    "within_doc": ('blocks { _id where within("d_3") or within("/talks/4.md") }', f"SELECT {_ID} AS _id FROM b WHERE c IN (3, 4)"),
    "nesting": ('blocks { _id, k: child_count(), p: parent_type(), m: _children { _text values } where _type == "task" }', f"SELECT {_ID} AS _id, CASE WHEN text LIKE 'check%' THEN 1 ELSE 0 END AS k, CASE WHEN text LIKE 'send%' THEN 'task' END AS p, CASE WHEN text LIKE 'check%' THEN ['send ' || c] ELSE [] END AS m FROM b WHERE type = 'task'"),
    "under_block": ('blocks { _id where under_kind("task", "check") or has_anchor() }', f"SELECT {_ID} AS _id FROM b WHERE text LIKE 'send%' AND type = 'task'"),
    "refs_lookup": ('docs { _id, t: refs(_path) { _title values } where refs(_path) exists { layer == "canon" } }', "SELECT id AS _id, [title] AS t FROM d WHERE layer = 'canon'"),
    "refs_dangling": ('links { _id, n: refs(_dst_node) count { } where _predicate == "md:link" and _dst_kind != "external" }', "SELECT 'e_' || src || '_' || o || '_2' AS _id, CASE WHEN dst LIKE 'd\\_%' ESCAPE '\\' THEN 1 ELSE 0 END AS n FROM e WHERE predicate = 'md:link' AND dst NOT LIKE 'https:%'"),
    "root_object": ('$it { d: docs count { }, l: links count { where _predicate == "md:wikilink" } }', "SELECT (SELECT count(*) FROM d) AS d, (SELECT count(*) FROM e WHERE predicate = 'md:wikilink') AS l"),
    "root_path": ('docs { _id, n: ^$it.blocks count { where _doc_id == ^_id and level == 2 } }', "SELECT id AS _id, n + 2 AS n FROM d"),
    "group_relation": ("blocks { l, n: count($rows), t: count($rows { select distinct _type values }) group by l: _doc.layer }", "SELECT layer AS l, count(*) AS n, count(DISTINCT type) AS t FROM b JOIN d USING (c) GROUP BY 1"),
}


def _over_store(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: execute(_store(spark, sf_dir), text)


# -- operators


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = talks(spark, sf_dir)
    return corpus.resolved(corpus.links(corpus.blocks(docs, "id", "text"), "id"), docs, "path", "id"), docs


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stale_links(_links(spark, sf_dir)[0], "id")


def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, docs = _links(spark, sf_dir)
    new = docs.select(F.concat(F.lit("talks/"), F.substring("id", 3, 20).cast("long") + 1, F.lit(".md")).alias("path"), F.concat(F.lit("new_"), F.substring("id", 3, 20).cast("long") + 1).alias("id"))
    return corpus.adopted(links, new, "path", "id").select("id", "dst", "dst_kind")


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, docs = _links(spark, sf_dir)
    return corpus.inbound(links, "dst", docs.where("id rlike '[02468]$'").select("id")).select("id", "dst", "kind")


def retarget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = talks(spark, sf_dir)
    moves = docs.where("id rlike '[05]$'").select(F.col("path").alias("old"), F.concat(F.lit("moved/"), "path").alias("new"))
    b = corpus.blocks(docs, "id", "text").where("type = 'paragraph'").select("id", "ordinal", "raw")
    return corpus.retargeted(b, "raw", moves).where("raw like 'See %'").select("id", "raw")


def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tree(_read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")), "path")


def edge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = corpus.html_links(_read(spark, sf_dir, "pages"), "page_id", "html").withColumn("predicate", F.lit("links"))
    return corpus.edge_counts(links, "predicate", "href", "page_id")


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.json_entries(_read(spark, sf_dir, "events"), "event_id", "props")


def talk_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.outline(corpus.blocks(talks(spark, sf_dir), "id", "text"), "id")


def talk_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.properties(corpus.blocks(talks(spark, sf_dir), "id", "text"), "id").select("id", "name", "value", "kind")


def computed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and tags of all conversations as Markdown, the role of each turn as a tag."""
    said = F.concat(F.lit("Turn #"), F.coalesce("role", F.lit("none")), F.lit(" and #"), F.coalesce("role", F.lit("none")), F.lit("\n\n"))
    rows = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))).alias("p"))
    text = F.concat(F.lit("## Not it\n\n# Talk "), "conv_id", F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["s"]), ""))
    return corpus.computed(corpus.blocks(rows.select("conv_id", text.alias("text")), "conv_id", "text"), "conv_id").select("conv_id", "name", "ord", "value")


def yaml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# a part\nname: '"), "p_name", F.lit("'\nsize: "), "p_size", F.lit("\nat:\n  brand: "), "p_brand", F.lit(" # note\n  kinds:\n  - "), "p_type", F.lit("\n  - other\n  parts: [{n: 1}]\nnone:\n"))
    return mapping.properties(_read(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text", "yaml")


def json_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "[1]").otherwise(F.concat(F.lit('{"p": '), "props", F.lit(', "l": [true, null]}'))).alias("text"), F.lit("json").alias("format"))
    return mapping.properties(rows, "event_id", "text")


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rendered from their blocks are the documents; only the last line end and the gaps are not theirs."""
    docs = talks(spark, sf_dir)
    got = corpus.rendered(corpus.blocks(docs, "id", "text").where("depth = 0"), "id")
    return got.select("id", F.md5(F.regexp_replace("text", r"\n+", "\n")).alias("digest"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), "role", F.col("turn").alias("seq"), F.coalesce(F.substring("text", 1, 1), F.lit("")).alias("first"))


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.dispositions(_turns(spark, sf_dir), "doc", "role", "seq", "first")


def feed_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, head = history.pruned(_read(spark, sf_dir, "events").select("event_id", "ts"), "event_id", "ts", "2024-02-15 00:00:00", 20, "second")
    return kept.select("event_id").crossJoin(F.broadcast(head))  # head is one row


def claims_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return history.released(claims, "o_orderkey", "o_orderdate", "1997-06-01 00:00:00", 100, [_read(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey")]).select("o_orderkey")


def squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("kept"))
    return history.squashed(r, "user_id", "event_id", "kept").select("user_id", "event_id", "squashed")


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.backlog_alerts(_read(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "2024-01-20 00:00:00", 60)


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), "ts")
    found = lambda now: feed.backlog_alerts(e.where("ts > timestamp '2024-01-10'") if now > "2024-01-15" else e, "repo", "ts", now, 60)
    known = found("2024-01-12 00:00:00").withColumn("since", F.lit("2024-01-12 00:00:00").cast("timestamp")).withColumn("cleared_at", F.lit(None).cast("timestamp"))
    return feed.updated_alerts(known, found("2024-01-20 00:00:00"), "2024-01-20 00:00:00").select("repo", "pending", "since", "cleared_at")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store.tables(talks(spark, sf_dir))
    return search.embed_tasks(t["blocks"], t["docs"], t["nodes"])


def embed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir).select("_id", "ctx", "ctx_hash", "weight")


def embed_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir)
    cache = tasks.where("weight > 60").select("content_hash", "ctx_hash", F.when(F.col("weight") > 90, "old").otherwise("new").alias("model"))
    return search.due(tasks, cache, "new").select("_id")


def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = store.tables(talks(spark, sf_dir))["blocks"]
    ranked = search.bm25(b, "_id", "_text", "said", 20).select("_id", "rank")
    return search.resolve(ranked, b).select("_id", "locator", "preview")


def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.hashed_vectors(_read(spark, sf_dir, "benchmark"), "item_id", "text", 16)
    return out.select("item_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The store's blocks as the edits read them, and with their types."""
    b = store.tables(talks(spark, sf_dir))["blocks"].select(F.col("_doc_id").alias("doc"), F.col("_id").alias("id"), F.col("_ordinal").alias("order"), F.col("_raw").alias("raw"), "_type", "_text", "checked", "level")
    return b.select("doc", "id", "order", "raw"), b


def write_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, typed = _blocks(spark, sf_dir)
    return apply_edits(rows, writes.complete_tasks(typed.where("checked = false")))[0].where("raw like '%[x]%'").select("id", "raw")


def write_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, typed = _blocks(spark, sf_dir)
    return apply_edits(rows, writes.rename_sections(typed.where("level = 2 and _text = 'Tasks'"), F.lit("To do")))[0].where("raw like '## T%'").select("id", "raw")


def write_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _blocks(spark, sf_dir)
    made = writes.append_to_documents(rows, rows.where("doc like '%0'").select("doc").distinct(), F.concat(F.lit("Seen "), "doc"))
    out = apply_edits(rows, made)[0]
    return out.groupBy("doc").agg(F.max_by("raw", "order").alias("raw"), F.count(F.lit(1)).alias("n"))


def write_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Tasks section goes in front of all, and gets one more item at its end."""
    rows, typed = _blocks(spark, sf_dir)
    part = typed.where("level = 2 and _text in ('Tasks', 'Links')").groupBy("doc").agg(F.min("order").alias("first"), (F.max("order") - 1).alias("last"))
    moved = apply_edits(rows, writes.move_sections(part, rows, F.lit(None).cast("string")))[0]
    end = moved.where("order = 2").select("doc", "id", "order")
    return apply_edits(moved, writes.insert_list_items(end, F.lit("more")))[0].where("order < 5").select("doc", "order", "raw")


def write_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _blocks(spark, sf_dir)
    hits = execute(_store(spark, sf_dir), 'blocks { doc: _doc_id, id: _id, order: _ordinal, raw: _raw where under_heading("turn 1 ") and _type == "paragraph" }')
    return apply_edits(rows, writes.directed(hits, "update", F.lit("gone"), 1_000_000_000))[0].where("raw = 'gone'").select("id")


def write_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, typed = _blocks(spark, sf_dir)
    return writes.plan(writes.complete_tasks(typed.where("_type = 'task'"))).select("edits", "documents")


def write_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents become their proposals, without the first heading, with the links first and the tasks' heading renamed."""
    rows, typed = _blocks(spark, sf_dir)
    new = typed.where("level is null or level = 2").select("doc", F.when(F.col("raw").like("See %"), -1).otherwise(F.col("order")).alias("order"), F.when(F.col("raw") == "## Tasks", "## To do").otherwise(F.col("raw")).alias("raw"))
    out, outcomes = apply_edits(rows, writes.update_documents(rows, new))
    failed = outcomes.where("error is not null").select("doc").distinct()
    return out.join(failed, "doc", "left_anti").groupBy("doc").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "raw"))), lambda x: x["raw"]), "|")).alias("digest"))


def stat_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("source").alias("mtime"))
    cache = listing.withColumn("size", F.when(F.col("path") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))).where("path % 11 <> 0")
    return feed.stale(cache, listing).select("path")


def resurrection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.recoverable(_read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("deleted_at")), "2024-02-10 00:00:00", 30).select("event_id")


def feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the streaming reader, batch by batch, into a table that counts them by type."""
    import uuid

    out = f"{feed.shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    events = _read(spark, sf_dir, "events").select("event_id", "event_type")
    events.write.parquet(f"{out}/in")
    feed.drain(feed.tail(spark, f"{out}/in", events.schema), feed.append(f"{out}/seen"), f"{out}/cursor").awaitTermination()
    return spark.read.option("basePath", f"{out}/seen").parquet(f"{out}/seen").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


def bound_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog.parquet(spark, sf_dir, ["orders"])
    rows = [{"k": 1, "least": 1000.0}, {"k": 2, "least": 100000.0}, {"k": 7, "least": None}]
    text = "${rows} { k, n: ^orders count { where o_custkey == ^k and o_totalprice >= ^least and o_orderstatus in ${states} } }"
    return execute(catalog, text, {"rows": rows, "states": ["O", "F"]})


def host_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog.parquet(spark, sf_dir, ["customer"])
    catalog.functions |= {"initials": lambda c: F.upper(F.substring(c, 1, 2)), "scaled": lambda c, k: F.round(c * k, 2)}
    return execute(catalog, "customer { c_custkey, i: initials(c_mktsegment), s: c_acctbal.scaled(2) where has(c_name) }")


def language_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = execute(Catalog.parquet(spark, sf_dir, ["part"]), "part { p_partkey, p_brand where p_size < 10 }", ordered=True)
    return rows.withColumn("at", F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).where("at <= 20").select("p_partkey", "at")


_STALE = "SELECT dst, count(*) AS n, list_sort(list(DISTINCT src))[:3] AS sources, count(DISTINCT src) AS \"of\" FROM e WHERE dst LIKE 'phantom:%' GROUP BY dst"
_LEAF = "l AS (SELECT b.c, b.o, b.text AS txt, 'Talk ' || b.c || ' · talks/' || b.c || '.md · Talk ' || b.c || ' › ' || s.text || ' · paragraph' AS ctx, ceil(len(string_split(b.text, ' ')) * 1.3)::BIGINT AS weight FROM b JOIN s ON s.c = b.c AND s.level = 2 AND b.o BETWEEN s.o AND s.last WHERE b.type = 'paragraph' AND len(string_split(b.text, ' ')) >= 24)"
_PENDING = "SELECT user_id AS repo, count(*) AS pending FROM events WHERE ts < TIMESTAMP '{now}' - INTERVAL 60 MINUTE AND ts > TIMESTAMP '{least}' GROUP BY 1"

#: name: (query, SQL or None); `{T}` stands for the store's common tables
DOMAIN: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    **{n: (_over_store(text), "WITH {T} " + sql) for n, (text, sql) in STORE.items()},
    "stale_links": (stale, "WITH {T} " + _STALE),
    "phantom_adoption": (adoption, "WITH {T} SELECT src AS id, CASE WHEN dst LIKE 'phantom:talks/%' THEN 'new_' || regexp_extract(dst, '([0-9]+)', 1) ELSE dst END AS dst, CASE WHEN dst LIKE 'https:%' THEN 'external' ELSE 'doc' END AS dst_kind FROM e"),
    "inbound_links": (inbound, "WITH {T} SELECT src AS id, dst, predicate AS kind FROM e WHERE dst LIKE 'd\\_%' ESCAPE '\\' AND regexp_matches(dst, '[02468]$')"),
    "retarget_links": (retarget, "WITH {T}, m AS (SELECT path FROM d WHERE regexp_matches(id, '[05]$')) SELECT id, 'See [next](' || CASE WHEN 'talks/' || (c + 1) || '.md' IN (SELECT path FROM m) THEN 'moved/' ELSE '' END || 'talks/' || (c + 1) || '.md) and [site](https://example.org/' || (c % 5) || ') and [[' || CASE WHEN 'talks/0.md' IN (SELECT path FROM m) THEN 'moved/' ELSE '' END || 'talks/0.md|zero]].' AS raw FROM d"),
    "directory_tree": (directory_tree, "WITH p AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS q FROM pages) SELECT array_to_string(q[:i], '/') AS directory, count(*) AS n FROM p, unnest(range(0, len(q))) AS r(i) GROUP BY 1"),
    "edge_samples": (edge_samples, "SELECT 'links' AS predicate, href, count(*) AS n, list_sort(list(DISTINCT page_id))[:3] AS samples FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY href"),
    "json_documents": (json_documents, "SELECT event_id, 'k' AS name, 'number' AS kind, props->>'k' AS value FROM events"),
    "computed_facts": (computed_facts, "WITH r AS (SELECT conv_id, coalesce(role, 'none') AS value, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, '_tags' AS name, (row_number() OVER (PARTITION BY conv_id ORDER BY t) - 1)::INT AS ord, value FROM r UNION ALL SELECT DISTINCT conv_id, '_title', 0, 'Talk ' || conv_id FROM conversations"),
    "yaml_documents": (yaml_documents, "SELECT p_partkey, r.* FROM part, LATERAL (VALUES ('name', 'scalar', 0, p_name, 'string'), ('size', 'scalar', 0, p_size::VARCHAR, 'number'), ('at.brand', 'scalar', 0, p_brand, 'string'), ('at.kinds', 'list', 0, p_type, 'string'), ('at.kinds', 'list', 1, 'other', 'string'), ('at.parts', 'list', 0, '[{\"n\":1}]', 'json'), ('none', 'scalar', 0, NULL, 'null')) AS r(name, card, ord, value, kind)"),
    "json_mappings": (json_mappings, "SELECT event_id, r.* FROM events, LATERAL (VALUES ('p.k', 'scalar', 0, props->>'k', 'number'), ('l', 'list', 0, 'true', 'bool'), ('l', 'list', 1, NULL, 'null')) AS r(name, card, ord, value, kind) WHERE event_id % 10 <> 0"),
    "talk_outline": (talk_outline, "WITH {T} SELECT 'd_' || c AS id, o AS ordinal, CASE WHEN level = 2 THEN '  ' ELSE '' END || text AS line FROM s"),
    "talk_properties": (talk_properties, "WITH {T} SELECT id, 'title' AS name, title AS value, 'string' AS kind FROM d UNION ALL SELECT id, 'layer', layer, 'string' FROM d"),
    "rebuilt_documents": (rebuilt, "WITH {T}, x AS (SELECT c, string_agg(CASE WHEN level IS NOT NULL THEN repeat('#', level) || ' ' ELSE '' END || text, chr(10) ORDER BY o) AS t FROM b WHERE type <> 'task' AND o < (SELECT 2 * n + 2 FROM d WHERE d.c = b.c) GROUP BY c) SELECT id, md5('---' || chr(10) || 'title: ' || title || chr(10) || 'layer: ' || layer || chr(10) || '---' || chr(10) || x.t || chr(10) || '## Tasks' || chr(10) || '- [x] check ' || c || chr(10) || '## Links' || chr(10) || (SELECT text FROM b WHERE b.c = d.c AND b.o = 2 * d.n + 6)) AS digest FROM d JOIN x USING (c)"),
    "dispositions": (dispositions, "SELECT conv_id AS doc, role, turn AS seq, CASE WHEN lag(turn) OVER w IS NULL THEN 'inserted' WHEN lag(coalesce(substr(text, 1, 1), '')) OVER w = coalesce(substr(text, 1, 1), '') THEN 'same' ELSE 'edited' END AS kind FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)"),
    "feed_prune": (feed_prune, "WITH k AS (SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-15' - INTERVAL 20 DAY OR event_id = (SELECT max(event_id) FROM events)) SELECT event_id, 'second' AS epoch, (SELECT min(event_id) FROM k) AS floor FROM k"),
    "claims_prune": (claims_prune, "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01' - INTERVAL 100 DAY AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)"),
    "squash": (squash, "WITH r AS (SELECT user_id, event_id, event_type = 'purchase' AS k, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events) SELECT user_id, max(event_id) FILTER (k) AS event_id, count(*) FILTER (NOT k) AS squashed FROM r GROUP BY user_id, run HAVING count(*) FILTER (k) > 0"),
    "backlog_alerts": (backlog, "SELECT user_id, 'materialization_backlog' AS code, 'warning' AS severity, count(*) AS pending, min(ts) AS oldest FROM events WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 60 MINUTE GROUP BY 1"),
    "alert_table": (alert_table, "WITH a AS (" + _PENDING.format(now="2024-01-12", least="1970-01-01") + "), z AS (" + _PENDING.format(now="2024-01-20", least="2024-01-10") + ") SELECT repo, coalesce(z.pending, a.pending) AS pending, CASE WHEN a.repo IS NULL THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-01-12' END AS since, CASE WHEN z.repo IS NULL THEN TIMESTAMP '2024-01-20' END AS cleared_at FROM a FULL JOIN z USING (repo)"),
    "embed_tasks": (embed_tasks, "WITH {T}, " + _LEAF + " SELECT 'b_d_' || c || '_' || o AS _id, ctx, sha256(ctx) AS ctx_hash, weight FROM l"),
    "embed_due": (embed_due, "WITH {T}, " + _LEAF + " SELECT 'b_d_' || c || '_' || o AS _id FROM l WHERE weight <= 60 OR weight > 90"),
    "resolve": (resolve, None),
    "hashed_vectors": (hashed_vectors, "WITH k AS (SELECT item_id, ('0x' || substr(md5(t), 1, 6))::BIGINT AS h FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark)), v AS (SELECT item_id, d, coalesce(sum(CASE WHEN h // 16 % 2 = 0 THEN 1.0 ELSE -1.0 END) FILTER (h % 16 = d), 0)::DOUBLE AS x FROM k, range(16) r(d) GROUP BY ALL), n AS (SELECT item_id, list(x ORDER BY d) AS v, sqrt(sum(x * x)) AS len FROM v GROUP BY 1) SELECT item_id, list_transform(v, lambda x: round(CASE WHEN len = 0 THEN 0 ELSE x / len END, 6)) AS vector FROM n"),
    "bound_rows": (bound_rows, "WITH r(k, least) AS (VALUES (1, 1000.0), (2, 100000.0), (7, NULL)) SELECT k::BIGINT AS k, (SELECT count(*) FROM orders WHERE o_custkey = k AND o_totalprice >= least AND o_orderstatus IN ('O', 'F')) AS n FROM r"),
    "host_functions": (host_functions, "SELECT c_custkey, upper(substr(c_mktsegment, 1, 2)) AS i, round(c_acctbal * 2, 2) AS s FROM customer"),
    "write_tasks": (write_tasks, "WITH {T} SELECT 'b_d_' || c || '_' || o AS id, CASE WHEN text LIKE 'send%' THEN '  - [x] ' ELSE '- [x] ' END || text AS raw FROM b WHERE type = 'task'"),
    "write_rename": (write_rename, "WITH {T} SELECT 'b_d_' || c || '_' || o AS id, CASE text WHEN 'Tasks' THEN '## To do' ELSE '## ' || text END AS raw FROM b WHERE level = 2 AND text LIKE 'T%'"),
    "write_append": (write_append, "WITH {T} SELECT id AS doc, CASE WHEN c % 10 = 0 THEN 'Seen ' || id ELSE (SELECT text FROM b WHERE b.c = d.c AND o = 2 * n + 6) END AS raw, 2 * n + 6 + CASE WHEN c % 10 = 0 THEN 1 ELSE 0 END AS n FROM d"),
    "write_sections": (write_sections, "WITH {T} SELECT id AS doc, unnest([0, 1, 2, 3, 4]) AS \"order\", unnest(['## Tasks', '- [x] check ' || c, '  - [ ] send ' || c, '- more', '# ' || title]) AS raw FROM d"),
    "write_directed": (write_directed, "WITH {T} SELECT 'b_d_' || c || '_' || (3 + 2 * i) AS id FROM t WHERE turn = 1"),
    "write_plan": (write_plan, "WITH {T} SELECT 2 * count(*) AS edits, count(*) AS documents FROM d"),
    "write_proposal": (write_proposal, "WITH {T}, r AS (SELECT c, CASE WHEN text LIKE 'See [%' THEN -1 ELSE o END AS o, CASE WHEN text = 'Tasks' AND level = 2 THEN '## To do' WHEN level = 2 THEN '## ' || text WHEN type = 'task' AND text LIKE 'check%' THEN '- [x] ' || text WHEN type = 'task' THEN '  - [ ] ' || text ELSE text END AS raw FROM b WHERE level IS NULL OR level = 2) SELECT 'd_' || c AS doc, md5(string_agg(raw, '|' ORDER BY o)) AS digest FROM r GROUP BY c"),
    "stat_sweep": (stat_sweep, "SELECT doc_id AS path FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0"),
    "resurrection": (resurrection, "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-02-10' - INTERVAL 30 DAY"),
    "feed_stream": (feed_stream, "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1"),
    "default_order": (language_order, "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey)::INT AS at FROM part WHERE p_size < 10 ORDER BY p_partkey LIMIT 20"),
}
DOMAIN = {n: (f, None if s is None else s.replace("{T}", _T)) for n, (f, s) in DOMAIN.items()}

QUERIES = {n: f for n, (f, _) in DOMAIN.items()}
ORACLE_SQL = {n: s for n, (_, s) in DOMAIN.items() if s is not None}
