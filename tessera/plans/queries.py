"""The registered queries: statements in the engine's dialect over the driver's tables, and their SQL for DuckDB.

A query is given once where both engines read the same text, otherwise with an oracle of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import relational, statements
from tessera.plans.dialect import rewrite
from tessera.plans.tokens import tokenize
from tessera.session import TABLES, load

#: Vectors of 768 dimensions, as text.
_LONG, _ZEROS = ("[" + ", ".join(str(x) for x in v) + "]" for v in ([i % 7 + 0.5 for i in range(768)], [0.0] * 768))

#: name -> (statement, oracle); an oracle of None means the same text, "" that there is none.
STATEMENTS: dict[str, tuple[str, str | None]] = {
    # Scans and projection
    "full_scan": ("SELECT * FROM nation", None),
    "pk_seek": ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42", None),
    "pk_range_seek": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 14000 AND o_orderkey < 14100", None),
    "index_seek": ("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_acctbal > 100", None),
    "projection_alias": ("SELECT o.o_orderkey AS key, o.o_totalprice * 2 AS doubled FROM orders AS o WHERE o.o_custkey = 10", None),
    "table_less": ("SELECT 1 AS one, 'x' AS x, 2 + 3 AS five", None),
    "distinct": ("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", None),
    # Predicates
    "comparisons": ("SELECT p_partkey FROM part WHERE p_size > 10 AND p_size <= 20 AND p_retailprice >= 950 AND p_size <> 15", None),
    "or_precedence": ("SELECT p_partkey, p_size FROM part WHERE p_size = 1 OR p_size = 2 AND p_brand = 'Brand#13'", None),
    "between_like": ("SELECT p_partkey, p_type FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type LIKE '%A%'", None),
    "not_like": ("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%A%' AND p_name LIKE '_a%'", None),
    "glob": ("SELECT c_custkey FROM customer WHERE c_name GLOB '*[1-3]'", None),
    "not_glob": ("SELECT c_custkey FROM customer WHERE c_name NOT GLOB '*[!1-3]?'", "SELECT c_custkey FROM customer WHERE NOT regexp_full_match(c_name, '.*[^1-3].', 's')"),
    "match": ("SELECT doc_id FROM documents WHERE text MATCH 'THE'", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')"),
    "in_list": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_orderstatus = 'F' OR o_totalprice > 200000)", None),
    "null_tests": ("SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL OR l.toxic IS NOT NULL AND l.quality = 0", None),
    "in_subquery": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)", None),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", None),
    "exists_subquery": ("SELECT c_custkey FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", None),
    "not_exists_subquery": ("SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", None),
    "derived_table": ("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS t GROUP BY n", None),
    "collate_nocase": ("SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE NOCASE = 'building'", None),
    "collate_rtrim": ("SELECT n_nationkey FROM nation WHERE n_name COLLATE RTRIM = rpad((SELECT min(n_name) FROM nation), 30, ' ')", "SELECT n_nationkey FROM nation WHERE rtrim(n_name) = (SELECT min(n_name) FROM nation)"),
    "glob_column": ("SELECT n_nationkey FROM nation WHERE n_name GLOB concat('*', substr(n_name, 1, 1), '?*') AND n_name NOT GLOB (CASE WHEN n_regionkey = 1 THEN '[A-C]*' ELSE '[!A-T]*' END)", "SELECT n_nationkey FROM nation WHERE regexp_full_match(n_name, '.*' || substr(n_name, 1, 1) || '..*', 's') AND NOT regexp_full_match(n_name, CASE WHEN n_regionkey = 1 THEN '[A-C].*' ELSE '[^A-T].*' END, 's')"),
    "match_column": ("SELECT n_nationkey FROM nation WHERE n_name MATCH lower(substr(n_name, 2, 2)) AND n_name MATCH CASE WHEN n_regionkey < 3 THEN 'an' ELSE 'ia' END", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), lower(substr(n_name, 2, 2))) AND contains(lower(n_name), CASE WHEN n_regionkey < 3 THEN 'an' ELSE 'ia' END)"),
    # Joins
    "join_natural": ("SELECT doc_id, quality FROM documents NATURAL JOIN labels", None),
    "join_comma": ("SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND n_regionkey = 2", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_range": ("SELECT p_partkey, b.band FROM part JOIN (SELECT 'small' AS band, 1 AS lo, 10 AS hi UNION ALL SELECT 'mid', 11, 30 UNION ALL SELECT 'big', 31, 60) AS b ON p_size BETWEEN b.lo AND b.hi", None),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3", None),
    "join_left": ("SELECT d.doc_id, l.quality FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id", None),
    "join_right": ("SELECT l.quality, d.doc_id FROM labels AS l RIGHT JOIN documents AS d ON l.doc_id = d.doc_id", None),
    "join_full": ("SELECT c.c_custkey, s.s_suppkey FROM customer AS c FULL JOIN supplier AS s ON c.c_custkey = s.s_suppkey + 1450", None),
    "join_chain": ("SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey LEFT JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE o.o_totalprice > 200000", None),
    "join_multi_key": ("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity > 45", None),
    "join_non_equi": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_using": ("SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id)", None),
    "self_join": ("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier AS a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", None),
    "join_order_limit": ("SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20 OFFSET 5", None),
    # Aggregation
    "agg_global": ("SELECT count(*) AS n, count(o_custkey) AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(sum(o_totalprice), 2) AS total FROM orders", None),
    "agg_empty": ("SELECT count(*) AS n, sum(p_size) AS s, avg(p_size) AS a, min(p_size) AS lo FROM part WHERE p_size < 0", "SELECT count(*) AS n, sum(p_size)::BIGINT AS s, avg(p_size) AS a, min(p_size) AS lo FROM part WHERE p_size < 0"),
    "agg_group": ("SELECT o_orderstatus, count(*) AS n, min(o_orderpriority) AS first, max(o_orderpriority) AS last FROM orders GROUP BY o_orderstatus", None),
    "agg_having": ("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag HAVING count(*) > 100 AND avg(l_quantity) > 1", None),
    "agg_nulls": ("SELECT count(nullif(n_regionkey, 1)) AS n, max(nullif(n_regionkey, 4)) AS hi, max(coalesce(nullif(n_regionkey, 4), 99)) AS filled FROM nation", None),
    "agg_null_group": ("SELECT l.quality, count(*) AS n FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id GROUP BY l.quality", None),
    "agg_expression": ("SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_linestatus", None),
    "agg_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag", None),
    "agg_multi_key": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_rollup": ("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)", None),
    "agg_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "agg_grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "agg_spread": ("SELECT p_brand, round(stddev(p_retailprice), 6) AS s, round(var_pop(p_retailprice), 4) AS v, round(corr(p_size, p_retailprice), 9) AS c FROM part GROUP BY p_brand", None),
    "agg_strings": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_over_join": ("SELECT n.n_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", None),
    "sum_int": ("SELECT p_brand, sum(p_size) AS s FROM part GROUP BY p_brand", "SELECT p_brand, sum(p_size)::BIGINT AS s FROM part GROUP BY p_brand"),
    # Windows
    "window_ranks": ("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM customer", None),
    "window_aggregates": ("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand) AS s, min(p_size) OVER (PARTITION BY p_brand) AS lo, max(p_size) OVER (PARTITION BY p_brand) AS hi, count(p_size) OVER (PARTITION BY p_brand) AS n, avg(p_size) OVER (PARTITION BY p_brand) AS a FROM part", "SELECT p_partkey, (sum(p_size) OVER w)::BIGINT AS s, min(p_size) OVER w AS lo, max(p_size) OVER w AS hi, count(p_size) OVER w AS n, avg(p_size) OVER w AS a FROM part WINDOW w AS (PARTITION BY p_brand)"),
    "window_count_star": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders", None),
    "window_whole": ("SELECT n_nationkey, sum(n_nationkey) OVER () AS s FROM nation", "SELECT n_nationkey, (sum(n_nationkey) OVER ())::BIGINT AS s FROM nation"),
    "window_running": ("SELECT o_orderkey, sum(1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders", "SELECT o_orderkey, (sum(1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders"),
    "window_offsets": ("SELECT c_custkey, lead(c_custkey) OVER w AS after, first_value(c_custkey) OVER w AS first, last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)", "SELECT c_custkey, lead(c_custkey) OVER w AS after, first_value(c_custkey) OVER w AS first, last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, (ntile(4) OVER w)::INT AS quarter, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)"),
    "window_range": ("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part", None),
    "window_top_n": ("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) AS t WHERE rn <= 3 ORDER BY c_nationkey, rn", None),
    # Sorting and limits
    "order_multi": ("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey LIMIT 50", None),
    "order_ordinal": ("SELECT n_name, n_nationkey FROM nation ORDER BY 1 LIMIT 5", None),
    "order_expression": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey % 7, n_nationkey LIMIT 9", None),
    "order_collate": ("SELECT n_name FROM nation ORDER BY n_name COLLATE NOCASE LIMIT 7", None),
    "order_date": ("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25", None),
    "order_nulls": ("SELECT k FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey FROM nation) AS t ORDER BY k, n_nationkey LIMIT 8", "SELECT k FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey FROM nation) AS t ORDER BY k NULLS FIRST, n_nationkey LIMIT 8"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "limit_early": ("SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 1000) AS t", None),
    "limit_comma": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4, 6", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 6 OFFSET 4"),
    # Sets
    "union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT c_nationkey FROM customer", None),
    "union": ("SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer", None),
    "intersect": ("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", None),
    "except": ("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem", None),
    "set_chain": ("SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9990", None),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "set_order_limit": ("SELECT k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_suppkey FROM supplier) AS t ORDER BY k DESC LIMIT 10", None),
    # Common table expressions
    "cte": ("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey", None),
    "cte_chain": ("WITH a AS (SELECT n_nationkey, n_regionkey FROM nation), b AS (SELECT n_regionkey, count(*) AS n FROM a GROUP BY n_regionkey) SELECT r_name, n FROM b JOIN region ON r_regionkey = n_regionkey", None),
    "cte_recursive": ("WITH RECURSIVE cnt(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM cnt WHERE x < 50) SELECT x FROM cnt", None),
    "cte_hierarchy": ("WITH RECURSIVE tree(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM nation AS n JOIN tree AS t ON n.n_nationkey IN (2 * t.k + 1, 2 * t.k + 2)) SELECT k, depth FROM tree", None),
    # Scalars
    "scalar_abs_length": ("SELECT c_custkey, abs(c_acctbal) AS a, length(c_name) AS n, octet_length(c_name) AS b FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, length(c_name)::INT AS n, strlen(c_name)::INT AS b FROM customer"),
    "scalar_typeof": ("SELECT typeof(p_partkey) AS a, typeof(p_retailprice) AS b, typeof(p_name) AS c, typeof(nullif(p_size, p_size)) AS d FROM part", "SELECT 'integer' AS a, 'real' AS b, 'text' AS c, 'null' AS d FROM part"),
    "scalar_cast": ("SELECT event_id, CAST(value AS INTEGER) AS i, CAST(event_id AS TEXT) AS t, CAST('12abc' AS INT) AS bad FROM events", "SELECT event_id, trunc(value)::INT AS i, event_id::VARCHAR AS t, NULL::INT AS bad FROM events"),
    "scalar_coalesce": ("SELECT d.doc_id, coalesce(l.quality, -1) AS q FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id", None),
    "scalar_strftime": ("SELECT o_orderkey, strftime('%Y-%m-%d %H:%M:%S', o_orderdate) AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d FROM orders"),
    "scalar_case": ("SELECT p_partkey, CASE WHEN p_size > 42 THEN 'top shelf' WHEN p_size >= 17 THEN 'middle' ELSE 'floor' END AS kind, p_retailprice * p_size AS value FROM part", None),
    "scalar_arithmetic": ("SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS b, p_size * 2 AS c, p_retailprice / (p_size - 10) AS d, p_size % 7 AS e FROM part", "SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS b, p_size * 2 AS c, p_retailprice / nullif(p_size - 10, 0) AS d, p_size % 7 AS e FROM part"),
    "scalar_case_fold": ("SELECT n_nationkey, lower(n_name) AS l, upper(n_name) AS u, concat(n_name, '!') AS c FROM nation", None),
    "json_extract": ("SELECT event_id, json_extract(props, '$.k') AS k, json_extract(props, '$.none') AS none FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS none FROM events"),
    "json_nested": ("SELECT event_id, json_extract(concat('{\"a\": {\"b\": ', event_id, ', \"c\": [1, ', user_id, ']}}'), '$.a.b') AS b, json_extract(concat('{\"a\": {\"c\": [1, ', user_id, ']}}'), '$.a.c[1]') AS c FROM events", "SELECT event_id, event_id::VARCHAR AS b, user_id::VARCHAR AS c FROM events"),
    "json_build": ("SELECT n_nationkey, json_object('k', n_nationkey, 'n', n_name) AS o, json_array(n_nationkey, n_name) AS a FROM nation", "SELECT n_nationkey, json_object('k', n_nationkey, 'n', n_name)::VARCHAR AS o, json_array(n_nationkey, n_name)::VARCHAR AS a FROM nation"),
    "random_now": ("SELECT n_nationkey, random() IS NOT NULL AS r, length(datetime('now')) AS d, length(date('now')) AS e, length(time('now')) AS t FROM nation", "SELECT n_nationkey, true AS r, 19 AS d, 10 AS e, 8 AS t FROM nation"),
    "scalar_text": ("SELECT n_nationkey, substr(n_name, 2, 3) AS a, trim(concat('  ', n_name, ' ')) AS b, replace(n_name, 'A', 'e') AS c, round(n_nationkey / 7, 3) AS d, ifnull(nullif(n_regionkey, 2), -1) AS e, instr(n_name, 'AN') AS f FROM nation", "SELECT n_nationkey, substr(n_name, 2, 3) AS a, trim(concat('  ', n_name, ' ')) AS b, replace(n_name, 'A', 'e') AS c, round(n_nationkey / 7, 3) AS d, coalesce(nullif(n_regionkey, 2), -1) AS e, instr(n_name, 'AN')::INT AS f FROM nation"),
    # Vectors
    "vector_long": (f"SELECT n_nationkey, round(l2_distance('{_LONG}', '{_ZEROS}') * n_nationkey, 6) AS d FROM nation", f"SELECT n_nationkey, round(list_distance({_LONG}::DOUBLE[], {_ZEROS}::DOUBLE[]) * n_nationkey, 6) AS d FROM nation"),
    "knn_l2": ("SELECT v.vec_id, round(l2_distance(v.embedding, q.embedding), 9) AS d FROM embeddings AS v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) AS q ORDER BY l2_distance(v.embedding, q.embedding), v.vec_id LIMIT 5", "SELECT v.vec_id, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS d FROM embeddings AS v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) AS q ORDER BY list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), v.vec_id LIMIT 5"),
    "knn_cosine": ("SELECT v.vec_id, round(cosine_similarity(v.embedding, q.embedding), 6) AS s FROM embeddings AS v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) AS q ORDER BY cosine_similarity(v.embedding, q.embedding) DESC, v.vec_id LIMIT 5", "SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS s FROM embeddings AS v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) AS q ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id LIMIT 5"),
    # The flagship
    "flagship": ("SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem AS l JOIN orders AS o ON l.l_orderkey = o.o_orderkey JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus <> 'P' GROUP BY n.n_name ORDER BY revenue DESC, n.n_name LIMIT 10", None),
}


def run(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A statement over the driver's tables; only those that it names are opened."""
    named = {t.text.lower() for t in tokenize(statement) if t.kind == "word"}
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "10000")
    for name in TABLES:
        if name in named:
            load(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(rewrite(statement))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: lambda spark, sf_dir, statement=statement: run(spark, sf_dir, statement) for name, (statement, _) in STATEMENTS.items()}
    return found | {f.__name__: f for f in (*relational.QUERIES, *statements.QUERIES)}


def oracle_sql() -> dict[str, str]:
    found = {name: statement if oracle is None else oracle for name, (statement, oracle) in STATEMENTS.items() if oracle != ""}
    return found | relational.ORACLES | statements.ORACLES
