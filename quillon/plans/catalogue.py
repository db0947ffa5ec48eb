"""Registered queries over the sample tables, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import Catalog
from .lower import execute

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]

#: name: (query, SQL)
CATALOGUE: dict[str, tuple[str, str]] = {
    "scan_project": ("nation { n_nationkey, n_name }", "SELECT n_nationkey, n_name FROM nation"),
    "filter_typed": ('lineitem { l_orderkey, l_partkey, l_quantity where l_quantity > 45 and l_returnflag == "R" }', "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'"),
    "filter_range": ("orders { o_orderkey where o_totalprice in 1000..5000 }", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 5000"),
    "filter_or_not": ('part { p_partkey where not (p_size > 10) or p_brand.startsWith("Brand#1") }', "SELECT p_partkey FROM part WHERE NOT (p_size > 10) OR starts_with(p_brand, 'Brand#1')"),
    "in_tuple": ('orders { o_orderkey where o_orderpriority in ("1-URGENT", "2-HIGH") }', "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "arith": ("lineitem { l_orderkey, l_linenumber, net: l_extendedprice * (1 - l_discount) }", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "mod_bucket": ("customer { b: c_custkey % 7, c_custkey }", "SELECT (c_custkey % 7)::DOUBLE AS b, c_custkey FROM customer"),
    "template": ("customer { c_custkey, label: `${c_name}/${c_mktsegment}` }", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer"),
    "logical_value": ("events { event_id, v: value or 0 }", "SELECT event_id, CASE WHEN coalesce(value, 0) <> 0 THEN value ELSE 0 END AS v FROM events"),
    "regex": ('part { p_partkey where p_name ~ "^[a-m]" }', "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m]')"),
    "regex_ci_not": ('customer { c_custkey where c_name !~* "0$" }', "SELECT c_custkey FROM customer WHERE NOT regexp_matches(c_name, '0$', 'i')"),
    "string_methods": ("documents { doc_id, u: source.upper(), n: size(text) }", "SELECT doc_id, upper(source) AS u, length(text)::INT AS n FROM documents"),
    "order_limit": ("orders { o_orderkey, o_totalprice order by o_totalprice desc, o_orderkey limit 25 offset 5 }", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5"),
    "top_k_per_parent": ("customer { c_custkey, o flatten ^orders { o_orderkey values where o_custkey == ^c_custkey order by o_totalprice desc, o_orderkey limit 3 } as o }", "SELECT o_custkey AS c_custkey, o_orderkey AS o FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) WHERE rn <= 3"),
    "group_basic": ("lineitem { l_returnflag, l_linestatus, n: count($rows), q: sum(l_quantity) group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus }", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL"),
    "group_expr_having": ("orders { y, n: count($rows) group by y: o_orderdate.year() having n > 10 }", "SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10"),
    "group_min_max": ("lineitem { l_returnflag, mn: min(l_discount), mx: max(l_tax) group by l_returnflag }", "SELECT l_returnflag, min(l_discount) AS mn, max(l_tax) AS mx FROM lineitem GROUP BY 1"),
    "group_first_last": ("events { user_id, f: first(event_type), l: last(event_type) group by user_id }", "SELECT user_id, arg_min(event_type, event_id) AS f, arg_max(event_type, event_id) AS l FROM events GROUP BY 1"),
    "group_collect": ("nation { n_regionkey, names: collect(n_name) group by n_regionkey }", "SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1"),
    "group_any_all": ("lineitem { l_returnflag, a: any($rows { l_discount > 0.09 values }), b: all($rows { l_tax < 0.5 values }) group by l_returnflag }", "SELECT l_returnflag, bool_or(l_discount > 0.09) AS a, bool_and(l_tax < 0.5) AS b FROM lineitem GROUP BY 1"),
    "group_distinct_count": ("orders { o_orderpriority, d: count($rows { select distinct o_custkey values }) group by o_orderpriority }", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS d FROM orders GROUP BY 1"),
    "group_rows_count": ('orders { o_orderpriority, n: $rows count { where o_orderstatus == "O" } group by o_orderpriority }', "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS n FROM orders GROUP BY 1"),
    "group_row_list": ("nation { n_regionkey, n_name group by n_regionkey }", "SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS n_name FROM nation GROUP BY 1"),
    "reduce_ungrouped": ("embeddings { vec_id, mn: min(embedding), n: count(embedding) }", "SELECT vec_id, list_min(embedding) AS mn, len(embedding)::INT AS n FROM embeddings"),
    "semi": ("orders { o_orderkey where ^lineitem exists { where l_orderkey == ^o_orderkey and l_quantity > 40 } }", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)"),
    "anti": ("customer { c_custkey where ^orders none { where o_custkey == ^c_custkey and o_totalprice > 300000 } }", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "mark": ("customer { c_custkey where c_acctbal > 9000 or ^orders exists { where o_custkey == ^c_custkey and o_totalprice > 300000 } }", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "count_join": ("customer { c_custkey, n: ^orders count { where o_custkey == ^c_custkey } }", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer"),
    "count_test": ("customer { c_custkey where ^orders count { where o_custkey == ^c_custkey } > 10 }", "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 10"),
    "lookup_join": ("nation { n_name, r: ^region[r_regionkey == ^n_regionkey].r_name }", "SELECT n_name, r_name AS r FROM nation LEFT JOIN region ON r_regionkey = n_regionkey"),
    "single_required": ("supplier { s_name, n: ^nation[n_nationkey == ^s_nationkey]!.n_name }", "SELECT s_name, n_name AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey"),
    "flat_join": ("orders { o_orderkey, q: l.l_quantity flatten ^lineitem { where l_orderkey == ^o_orderkey } as l }", "SELECT o_orderkey, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey"),
    "nest_join": ("region { r_name, ns: ^nation { n_name values where n_regionkey == ^r_regionkey } }", "SELECT r_name, list(n_name ORDER BY n_nationkey) AS ns FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"),
    "theta_join": ("nation { n_nationkey, n: ^nation count { where n_nationkey < ^n_nationkey and n_regionkey == ^n_regionkey } }", "SELECT a.n_nationkey, (SELECT count(*) FROM nation b WHERE b.n_nationkey < a.n_nationkey AND b.n_regionkey = a.n_regionkey) AS n FROM nation a"),
    "asof": ("events { event_id, prev: ^events first { event_id values where user_id == ^user_id and ts < ^ts order by ts desc, event_id desc } }", "SELECT a.event_id, (SELECT b.event_id FROM events b WHERE b.user_id = a.user_id AND b.ts < a.ts ORDER BY b.ts DESC, b.event_id DESC LIMIT 1) AS prev FROM events a"),
    "lift": ("customer { c_name, bigs where ^orders collect { ^bigs: o_totalprice where o_custkey == ^c_custkey and o_totalprice > 300000 } }", "SELECT c_name, list(o_totalprice ORDER BY o_orderkey) AS bigs FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey, c_name"),
    "distinct_proj": ("orders { select distinct o_orderpriority, o_orderstatus }", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders"),
    "union_tuple": ("(customer { k: c_nationkey }, supplier { k: s_nationkey }) { k }", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "flatten_embed": ("embeddings { vec_id, x flatten embedding as x }", "SELECT vec_id, unnest(embedding) AS x FROM embeddings"),
    "dates": ('orders { o_orderkey, d: o_orderdate.date(), w: o_orderdate.weekday(), f: o_orderdate.format("yyyy/MM") }', "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, isodow(o_orderdate)::INT AS w, strftime(o_orderdate, '%Y/%m') AS f FROM orders"),
    "follow_tree": ("part { p_partkey, d: $depth, s: $stop where p_partkey == 1 follow ^part { where (p_partkey - p_partkey % 2) / 2 == ^p_partkey and p_partkey > 1 depth 4 } }", "WITH RECURSIVE w AS (SELECT p_partkey, 1 AS d FROM part WHERE p_partkey = 1 UNION ALL SELECT c.p_partkey, d + 1 FROM w JOIN part c ON c.p_partkey // 2 = w.p_partkey AND c.p_partkey > 1 WHERE d < 4) SELECT p_partkey, d, CASE WHEN d = 4 THEN 'depth' WHEN EXISTS (SELECT 1 FROM part c WHERE c.p_partkey // 2 = w.p_partkey) THEN 'interior' ELSE 'leaf' END AS s FROM w"),
    "follow_distinct": ("nation { n_nationkey, d: $depth follow distinct ^nation { where n_regionkey == ^n_regionkey and n_nationkey > ^n_nationkey depth 3 } }", "SELECT n_nationkey, 1 AS d FROM nation"),
    "follow_cycle": ("nation { n_nationkey, d: $depth, s: $stop, o: $ordinal where n_regionkey == 0 follow ^nation { where n_regionkey == ^n_regionkey depth 4 } }", "WITH RECURSIVE n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_regionkey = 0), w AS (SELECT k, r, 1 AS d, [k] AS p, false AS c FROM n UNION ALL SELECT n.k, n.r, d + 1, list_append(p, n.k), list_contains(p, n.k) FROM w JOIN n ON n.r = w.r WHERE d < 4 AND NOT w.c) SELECT k AS n_nationkey, d, CASE WHEN c THEN 'cycle' WHEN d = 4 THEN 'depth' ELSE 'interior' END AS s, row_number() OVER (ORDER BY d, p) AS o FROM w"),
    "follow_leaves": ("part { p_partkey where p_partkey == 40 and $leaf follow ^part { where (p_partkey - p_partkey % 2) / 2 == ^p_partkey } }", "WITH RECURSIVE w AS (SELECT p_partkey, 1 AS d FROM part WHERE p_partkey = 40 UNION ALL SELECT c.p_partkey, d + 1 FROM w JOIN part c ON c.p_partkey // 2 = w.p_partkey WHERE d < 8) SELECT p_partkey FROM w WHERE d < 8 AND NOT EXISTS (SELECT 1 FROM part c WHERE c.p_partkey // 2 = w.p_partkey)"),
    "two_level": ("region { r_name, n: ^nation count { where n_regionkey == ^r_regionkey and ^^customer count { where c_nationkey == ^n_nationkey and c_custkey > ^^r_regionkey } > 2 } }", "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey > r_regionkey) > 2) AS n FROM region"),
    "nested_group": ("region { r_name, gs: ^supplier { s_nationkey, n: count($rows) where s_nationkey == ^r_regionkey group by s_nationkey } }", "SELECT r_name, CASE WHEN count(s_suppkey) = 0 THEN [] ELSE [{'s_nationkey': r_regionkey, 'n': count(s_suppkey)}] END AS gs FROM region LEFT JOIN supplier ON s_nationkey = r_regionkey GROUP BY r_name, r_regionkey"),
    "group_count_join": ("nation { n_name, n: ^customer count { where c_nationkey == ^n_nationkey group by c_mktsegment } }", "SELECT n_name, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation"),
    "clause_form": ('select n_name from nation where n_regionkey == 1 order by n_name', "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "from_join": ("region { select n_name from ^nation { where n_regionkey == ^r_regionkey } }", "SELECT n_name FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "intersect": ("customer { select distinct c_nationkey where ^supplier exists { where s_nationkey == ^c_nationkey } }", "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "except": ("orders { select distinct o_custkey where ^customer none { where c_custkey == ^o_custkey and c_acctbal > 0 } }", "SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0"),
    "date_plus": ('orders { o_orderkey, a: o_orderdate.plus("1 month"), b: o_orderdate.minus(86400), u: o_orderdate.until("1998-01-01") }', "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - INTERVAL 1 DAY AS b, date_diff('second', o_orderdate, TIMESTAMP '1998-01-01')::DOUBLE AS u FROM orders"),
    "durations": ('events { event_id, d: (event_id * 61).dur_text(), s: dur("1h 30m") + event_id }', "SELECT event_id, CASE WHEN event_id = 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN event_id * 61 >= 86400 THEN (event_id * 61 // 86400) || 'd' END, CASE WHEN (event_id * 61 // 3600) % 24 > 0 THEN (event_id * 61 // 3600) % 24 || 'h' END, CASE WHEN (event_id * 61 // 60) % 60 > 0 THEN (event_id * 61 // 60) % 60 || 'm' END, CASE WHEN event_id * 61 % 60 > 0 THEN event_id * 61 % 60 || 's' END) END AS d, 5400 + event_id::DOUBLE AS s FROM events"),
    "entries": ("embeddings { vec_id, k: e.key, v: e.value flatten entries(embedding) as e }", "SELECT vec_id, i::INT AS k, embedding[i + 1] AS v FROM embeddings, unnest(range(len(embedding))) AS t(i)"),
    "json_props": ("events { event_id, k: props.k where props.k > 50 }", "SELECT event_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k')::INT > 50"),
    "list_top": ("embeddings { vec_id, best: embedding { $it values where $it > 0 order by $it desc limit 3 } }", "SELECT vec_id, list_reverse_sort(list_filter(embedding, lambda x: x > 0))[:3] AS best FROM embeddings"),
    "group_avg": ("lineitem { l_returnflag, a: avg(l_quantity) group by l_returnflag }", "SELECT l_returnflag, avg(l_quantity) AS a FROM lineitem GROUP BY 1"),
    "whole_count": ("lineitem count { where l_quantity > 10 }", "SELECT count(*) AS value FROM lineitem WHERE l_quantity > 10"),
    "row_itself": ("region { where r_regionkey > 1 }", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1"),
    "identity": ("orders { o_orderkey where o_custkey is 7 or o_orderkey is not o_orderkey }", "SELECT o_orderkey FROM orders WHERE o_custkey = 7"),
    "string_plus": ('part { p_partkey, s: p_name + "/" + p_size }', "SELECT p_partkey, p_name || '/' || p_size AS s FROM part"),
    "present": ("events { user_id, v: value? group by user_id }", "SELECT user_id, list(value ORDER BY event_id) FILTER (value IS NOT NULL) AS v FROM events GROUP BY 1"),
    "list_has": ("embeddings { vec_id, n: size(list(label)), h: has(embedding), c: list(label).contains(3) }", "SELECT vec_id, 1 AS n, true AS h, label = 3 AS c FROM embeddings"),
    "contains_text": ('documents { doc_id where text.contains("un") }', "SELECT doc_id FROM documents WHERE contains(text, 'un')"),
    "multi_key": ("lineitem { l_orderkey, l_linenumber, b: ^orders[o_orderkey == ^l_orderkey and o_custkey == ^l_suppkey].o_totalprice }", "SELECT l_orderkey, l_linenumber, o_totalprice AS b FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_custkey = l_suppkey"),
    "uncorrelated": ("region { r_name, n: ^nation count { where n_nationkey > 20 }, m: ^part first { p_partkey values order by p_retailprice desc, p_partkey } }", "SELECT r_name, (SELECT count(*) FROM nation WHERE n_nationkey > 20) AS n, (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1) AS m FROM region"),
    "group_default": ("orders { group by o_orderpriority }", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1"),
    "first_whole": ("orders first { o_orderkey, o_totalprice order by o_totalprice desc, o_orderkey }", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1"),
    "single_whole": ("region single { r_name where r_regionkey == 2 }", "SELECT r_name FROM region WHERE r_regionkey = 2"),
    "exists_whole": ("orders exists { where o_totalprice > 400000 }", "SELECT count(*) > 0 AS value FROM orders WHERE o_totalprice > 400000"),
    "union_distinct": ("(customer { k: c_nationkey }, supplier { k: s_nationkey }) { select distinct k }", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "seed_frontier": ("nation { n_nationkey, d: $depth, f: $frontier where n_regionkey == 0 frontier n_nationkey == 0 follow ^nation { where n_regionkey == ^n_regionkey and n_nationkey > ^n_nationkey depth 2 } }", "WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0) SELECT k AS n_nationkey, 1 AS d, k = 0 AS f FROM n UNION ALL SELECT b.k, 2, true FROM n a JOIN n b ON b.k > a.k WHERE a.k <> 0"),
    "bounded_test": ("customer { c_custkey where ^orders exists { where o_custkey == ^c_custkey offset 12 } }", "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 12"),
    "bounded_count": ("customer { c_custkey, n: ^orders count { where o_custkey == ^c_custkey limit 5 offset 2 } }", "SELECT c_custkey, least(greatest((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) - 2, 0), 5) AS n FROM customer"),
    "rows_block": ("nation { n_regionkey, top: $rows first { n_name values order by n_nationkey desc }, late: $rows collect { n_name values where n_nationkey > 10 limit 2 } group by n_regionkey }", "SELECT n_regionkey, arg_max(n_name, n_nationkey) AS top, coalesce(list(n_name ORDER BY n_nationkey) FILTER (n_nationkey > 10), [])[:2] AS late FROM nation GROUP BY 1"),
    "collect_distinct": ("orders { o_orderstatus, p: collect($rows { select distinct o_orderpriority values order by o_orderpriority }) group by o_orderstatus }", "SELECT o_orderstatus, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS p FROM orders GROUP BY 1"),
    "rows_ungrouped": ("lineitem { l_orderkey, l_linenumber, s: sum($rows { l_quantity * l_extendedprice values }), n: count($rows) }", "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS s, 1 AS n FROM lineitem"),
    "sum_absent": ("events { event_id, s: sum(nope), c: sum(value) }", "SELECT event_id, 0.0::DOUBLE AS s, coalesce(value, 0)::DOUBLE AS c FROM events"),
    "guarded": ("events { event_id where false and foo(event_id) or value > 50 }", "SELECT event_id FROM events WHERE value > 50"),
    "mixed_tuple": ('part { p_partkey where p_size in (1, "x", 7, null) }', "SELECT p_partkey FROM part WHERE p_size IN (1, 7) OR p_size IS NULL"),
    "text_range": ('orders { o_orderkey where o_orderdate.date() in range("1995-01-01...1996-01-01") and o_totalprice in range("1000..200000") }', "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01' AND o_totalprice BETWEEN 1000 AND 200000"),
    "list_group": ("embeddings { vec_id, g: embedding { s, n: count($rows) group by s: $it > 0 order by n desc, s } }", "WITH c AS (SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS p, len(embedding) AS n FROM embeddings) SELECT vec_id, CASE WHEN p > n - p THEN [{'s': true, 'n': p}, {'s': false, 'n': n - p}] ELSE [{'s': false, 'n': n - p}, {'s': true, 'n': p}] END AS g FROM c"),
    "list_distinct": ("embeddings { vec_id, n: embedding count { select distinct $it > 0 values }, f: embedding first { $it values order by $it desc } }", "SELECT vec_id, len(list_distinct(list_transform(embedding, lambda x: x > 0)))::INT AS n, list_max(embedding) AS f FROM embeddings"),
    "theta_count": ("events { event_id, n: ^events count { where user_id == ^user_id and ts < ^ts } }", "SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS n FROM events"),
    "nearest_after": ("events { event_id, nxt: ^events first { event_id values where user_id == ^user_id and ts > ^ts order by ts, event_id } }", "SELECT a.event_id, (SELECT b.event_id FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts ORDER BY b.ts, b.event_id LIMIT 1) AS nxt FROM events a"),
    "alias_chain": ("lineitem { l_orderkey, l_linenumber, gross: l_extendedprice * 2, net: gross - l_discount where net > 1000 }", "SELECT l_orderkey, l_linenumber, l_extendedprice * 2 AS gross, l_extendedprice * 2 - l_discount AS net FROM lineitem WHERE l_extendedprice * 2 - l_discount > 1000"),
    "intrinsics": ("nation { k: $key, n: $it.n_name }", "SELECT n_nationkey AS k, n_name AS n FROM nation"),
    "membership_join": ("region { r_name, n: ^nation count { where n_regionkey in (^r_regionkey, 3) } }", "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey IN (r_regionkey, 3)) AS n FROM region"),
    "flatten_bounds": ("region { r_name, n flatten ^nation { n_name values where n_regionkey == ^r_regionkey order by n_name desc limit 2 offset 1 } as n }", "SELECT r_name, n_name AS n FROM region JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) AS k FROM nation) ON n_regionkey = r_regionkey WHERE k IN (2, 3)"),
}


#: Schemas of the columns that hold JSON texts.
JSON = {"events": {"props": "k int"}}


def tables(spark: SparkSession, sf_dir: str) -> Catalog:
    """The sample tables as a catalog."""
    out = Catalog.parquet(spark, sf_dir, TABLES)
    for name, columns in JSON.items():
        out.add(name, out.tables[name], out.keys[name], columns)
    return out


def _callable(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: execute(tables(spark, sf_dir), text)


QUERIES = {name: _callable(text) for name, (text, _) in CATALOGUE.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in CATALOGUE.items()}
