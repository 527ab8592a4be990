"""Every query of the engine with its SQL. Importing this registers them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltql.functions.scalar import FUNCTIONS, call
from basaltql.operators import changes, frames, hierarchy, retrieval
from basaltql.plans.registry import query
from basaltql.sources import tables
from basaltql.streaming import windows

t = tables.table


def sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """A query that Spark SQL states; the oracle is the same text unless given."""

    names = tuple(n for n in tables.TABLES if re.search(rf"\b{n}\b", spark_sql))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.attach(spark, sf_dir, names=names)
        return spark.sql(spark_sql)

    query(name, oracle or spark_sql)(run)


D = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"
# --- filters, projections, expressions
sql("tpch_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS sum_base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
sql("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount < 0.05")
sql("filter_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 7 = 0")
sql("filter_like", "SELECT c_custkey FROM customer WHERE c_name LIKE '%1_' OR c_mktsegment LIKE 'BUILD%'")
sql("filter_tuple_in", "SELECT l_orderkey FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('R', 'F')) AND l_quantity > 45")
sql("null_safe_compare", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL")
sql("case_searched", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class, count(*) AS n FROM part GROUP BY 1")
sql("case_simple", "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS status, count(*) AS n FROM orders GROUP BY 1")
sql("cast_lenient", "SELECT try_cast(substr(c_name, 10) AS BIGINT) AS number, c_custkey FROM customer")
sql("bit_operators", "SELECT o_orderkey, o_orderkey & 255 AS low, o_orderkey | 1 AS odd FROM orders")
sql("is_true", "SELECT count(*) AS n FROM orders WHERE (o_totalprice > 1000) IS TRUE")
sql("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(k, s)")
sql("quantified_any", "SELECT count(*) AS n FROM supplier WHERE s_acctbal > (SELECT min(c_acctbal) FROM customer WHERE c_nationkey = 3)")
sql("quantified_all", "SELECT count(*) AS n FROM supplier WHERE s_acctbal > (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = 3)")
sql("from_subquery", "SELECT s, count(*) AS n FROM (SELECT c_mktsegment AS s, c_acctbal AS b FROM customer) x WHERE b > 0 GROUP BY s")
# --- joins
sql("join_inner", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
sql("join_right", "SELECT r_name, count(n_nationkey) AS n FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey < 10 GROUP BY r_name")
sql("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 8) b ON a.k = b.k")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_using", "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') o USING (l_orderkey) GROUP BY l_orderkey")
sql("join_natural", "SELECT count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) a NATURAL JOIN (SELECT l_orderkey AS k FROM lineitem) b")
sql("join_theta", "SELECT count(*) AS n FROM supplier s JOIN nation ON s_nationkey < n_nationkey")
sql("join_lateral", "SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x")
sql("join_semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
sql("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql("join_anti_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("join_anti_not_in", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
sql("scalar_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
sql("join_star", f"SELECT r_name, sum({D}) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
# --- aggregates
for _agg in ("count", "min", "max", "bit_and", "bit_or", "bit_xor"):
    sql(f"agg_{_agg}", f"SELECT p_brand, {_agg}(p_size) AS v FROM part GROUP BY p_brand")
for _agg in ("avg", "median", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp"):
    sql(f"agg_{_agg}", f"SELECT p_brand, round({_agg}(p_size), 6) AS v FROM part GROUP BY p_brand")
for _agg in ("covar_pop", "covar_samp", "corr", "regr_count", "regr_avgx", "regr_avgy", "regr_slope", "regr_intercept", "regr_sxx", "regr_syy", "regr_sxy", "regr_r2"):
    sql(f"agg_{_agg}", f"SELECT p_brand, round(CAST({_agg}(p_retailprice, p_size) AS DOUBLE), 5) AS v FROM part GROUP BY p_brand")
sql("agg_sum", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS v FROM part GROUP BY p_brand")
sql("agg_total", "SELECT p_brand, coalesce(sum(CAST(CASE WHEN p_size > 48 THEN p_size END AS DOUBLE)), 0e0) AS v FROM part GROUP BY p_brand")
sql("agg_count_distinct", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY c_mktsegment")
sql("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY o_orderpriority")
sql("agg_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_group_concat", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql("agg_percentile_cont", "SELECT p_brand, percentile_cont(0.25) WITHIN GROUP (ORDER BY p_size) AS v FROM part GROUP BY p_brand")
sql("agg_percentile_disc", "SELECT p_brand, CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY p_size) AS BIGINT) AS v FROM part GROUP BY p_brand")
sql("agg_mode", "SELECT c_nationkey, mode() WITHIN GROUP (ORDER BY c_mktsegment) AS v FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, v FROM (SELECT c_nationkey, c_mktsegment AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1")
sql("agg_json_array", "SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list_sort(list(n_nationkey))) AS VARCHAR) AS keys FROM nation GROUP BY n_regionkey")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql("agg_nested", "SELECT max(m) AS v FROM (SELECT min(p_size) AS m FROM part GROUP BY p_brand) x")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS INT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("agg_composite_grouping", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, ROLLUP (o_orderpriority)")
sql("select_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
# --- windows
W = "PARTITION BY c_nationkey ORDER BY c_custkey"
for _f, _call in {"row_number": "row_number()", "rank": "rank()", "dense_rank": "dense_rank()", "ntile": "ntile(4)"}.items():
    sql(f"window_{_f}", f"SELECT c_custkey, CAST({_call} OVER ({W}) AS INT) AS v FROM customer")
for _f, _call in {"percent_rank": "percent_rank()", "cume_dist": "cume_dist()"}.items():
    sql(f"window_{_f}", f"SELECT c_custkey, round({_call} OVER ({W}), 8) AS v FROM customer")
for _f, _call in {"lag": "lag(c_mktsegment, 2, 'none')", "lead": "lead(c_mktsegment)", "first_value": "first_value(c_mktsegment)", "last_value": "last_value(c_mktsegment)", "nth_value": "nth_value(c_mktsegment, 2)"}.items():
    sql(f"window_{_f}", f"SELECT c_custkey, {_call} OVER ({W}) AS v FROM customer")
sql("window_ignore_nulls", f"SELECT c_custkey, lag(nullif(c_mktsegment, 'BUILDING')) IGNORE NULLS OVER ({W}) AS v FROM customer", f"SELECT c_custkey, lag(nullif(c_mktsegment, 'BUILDING') IGNORE NULLS) OVER ({W}) AS v FROM customer")
sql("window_rows_frame", f"SELECT c_custkey, CAST(sum(c_custkey) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS v FROM customer")
sql("window_range_frame", f"SELECT c_custkey, count(*) OVER ({W} RANGE BETWEEN 50 PRECEDING AND 10 FOLLOWING) AS v FROM customer")
sql("window_named", "SELECT c_custkey, count(*) OVER w AS n, min(c_custkey) OVER w AS m FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
sql("window_over_aggregate", "SELECT o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM orders GROUP BY o_orderstatus")


@query("window_groups_frame", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS v FROM part")
def _(spark, d):
    return frames.groups_frame(t(spark, d, "part"), ["p_brand"], "p_size", -1, 1, F.sum("p_size"), "v").select("p_partkey", "v")


for _kind, _words in {"current row": "CURRENT ROW", "group": "GROUP", "ties": "TIES"}.items():
    for _agg in ("sum", "count", "min", "max", "avg"):
        #: sum keeps the shortest name.
        _name = f"window_exclude_{_kind.replace(' ', '_')}" + ("" if _agg == "sum" else f"_{_agg}")
        _frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"

        @query(_name, f"SELECT p_partkey, round(CAST({_agg}(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey % 2 {_frame} EXCLUDE {_words}) AS DOUBLE), 6) AS v FROM part")
        def _(spark, d, kind=_kind, agg=_agg):
            return frames.excluding(t(spark, d, "part"), ["p_brand"], ["p_size", F.col("p_partkey") % 2], "p_size", agg, kind, "v").select("p_partkey", F.round(F.col("v").cast("double"), 6).alias("v"))

    for _agg in ("sum", "count", "min", "max"):

        @query(f"window_exclude_{_kind.replace(' ', '_')}_bounded_{_agg}", f"SELECT p_partkey, CAST({_agg}(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE {_words}) AS BIGINT) AS v FROM part")
        def _(spark, d, kind=_kind, agg=_agg):
            return frames.excluding(t(spark, d, "part"), ["p_brand"], ["p_partkey"], "p_size", agg, kind, "v", -2, 1).select("p_partkey", F.col("v").cast("long"))


@query("window_ratio_to_report", "SELECT c_custkey, round(CAST(c_custkey AS DOUBLE) / sum(c_custkey) OVER (PARTITION BY c_nationkey), 8) AS v FROM customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.round(frames.ratio_to_report("c_custkey", ["c_nationkey"]), 8).alias("v"))


@query("agg_keep_dense_rank", "SELECT c_nationkey, min(c_custkey) AS k, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment NULLS LAST) AS r FROM customer) WHERE r = 1 GROUP BY c_nationkey")
def _(spark, d):
    return frames.keep_dense_rank(t(spark, d, "customer"), ["c_nationkey"], F.col("c_mktsegment").asc_nulls_last(), [F.min("c_custkey").alias("k"), F.count("*").alias("n")])


# --- order, limits, sets
sql("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("order_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
sql("set_union", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region")
sql("set_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region")
sql("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql("set_nested", "SELECT n_nationkey AS k FROM nation UNION (SELECT r_regionkey FROM region EXCEPT SELECT 1)")


@query("fetch_percent", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n FROM customer) WHERE r <= ceil(n * 0.1)")
def _(spark, d):
    return frames.fetch_percent(t(spark, d, "customer").select("c_custkey"), [F.col("c_custkey")], 10)


# --- CTEs, hierarchies, patterns, pivots
sql("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
sql("cte_recursive", "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n FROM s")
EDGES = "SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS up FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


@query("connect_by", f"WITH RECURSIVE e AS ({EDGES}), h AS (SELECT id, up, 1 AS level, id AS root, '/' || id AS path FROM e WHERE up IS NULL UNION ALL SELECT e.id, e.up, h.level + 1, h.root, h.path || '/' || e.id FROM e JOIN h ON e.up = h.id) SELECT id, level, root, path, CAST(NOT EXISTS (SELECT 1 FROM e c WHERE c.up = h.id) AS INT) AS is_leaf FROM h")
def _(spark, d):
    tables.attach(spark, d)
    edges = spark.sql(EDGES.replace("AS VARCHAR", "AS STRING"))
    return hierarchy.connect_by(edges, "id", "up", F.col("up").isNull()).select("id", "level", "root", "path", "is_leaf")


@query("match_recognize", "WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, CASE WHEN value > lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS up FROM events), g AS (SELECT user_id, r - row_number() OVER (PARTITION BY user_id, up ORDER BY r) AS g, up FROM l) SELECT user_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS rises FROM (SELECT user_id, g, count(*) AS c FROM g WHERE up = 1 GROUP BY user_id, g) GROUP BY user_id")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = t(spark, d, "events").withColumn("was", F.lag("value").over(w))
    runs = hierarchy.match_recognize(events, ["user_id"], ["ts", "event_id"], {"UP": F.coalesce(F.col("value") > F.col("was"), F.lit(False))}, "UP+", {"c": ("UP", "value", "count")})
    return runs.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("c").alias("rises"))


sql("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (count(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY l_returnflag")


@query("unpivot", "SELECT s_suppkey, s_nationkey, m, v FROM (SELECT s_suppkey, s_nationkey, 'a' AS m, s_suppkey AS v FROM supplier UNION ALL SELECT s_suppkey, s_nationkey, 'b', s_nationkey FROM supplier)")
def _(spark, d):
    rows = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    return frames.unpivot(rows, ["a", "b"], "m", "v").select("s_suppkey", "s_nationkey", "m", "v")


# --- row sources
query("generate_series", "SELECT range AS value FROM range(5, 101, 5)")(lambda spark, d: tables.generate_series(spark, 5, 100, 5))
query("generate_series_down", "SELECT CAST(20 - 3 * range AS BIGINT) AS value FROM range(0, 7)")(lambda spark, d: tables.generate_series(spark, 20, 1, -3))
query("dual", "SELECT 'X' AS dummy")(lambda spark, d: tables.dual(spark))
sql("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql("json_each", "SELECT event_id, key, CAST(value AS STRING) AS v FROM (SELECT event_id, props FROM events), LATERAL variant_explode(parse_json(props))", "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS v FROM events")
sql("json_table", "SELECT event_id, j.k FROM events LATERAL VIEW explode(array(from_json(props, 'k BIGINT'))) x AS j", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
query("table_info", "SELECT CAST(ordinal_position - 1 AS INT) AS cid, column_name AS name, CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type, 0 AS notnull FROM information_schema.columns WHERE table_name = 'orders'")(lambda spark, d: tables.columns_of(spark, t(spark, d, "orders")))

# --- changes
SOURCE = "SELECT c_custkey + 100 AS c_custkey, 'new' AS c_name FROM customer WHERE c_custkey <= 200"


@query("merge", f"WITH s AS ({SOURCE}) SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name FROM customer t FULL JOIN s ON t.c_custkey = s.c_custkey")
def _(spark, d):
    tables.attach(spark, d)
    return changes.merge(t(spark, d, "customer").select("c_custkey", "c_name"), spark.sql(SOURCE), "c_custkey", {"c_name": F.col("s.c_name")})


@query("upsert_ignore", f"WITH s AS ({SOURCE}) SELECT c_custkey, c_name FROM customer UNION ALL SELECT * FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    tables.attach(spark, d)
    return changes.insert_or_ignore(t(spark, d, "customer").select("c_custkey", "c_name"), spark.sql(SOURCE), "c_custkey")


@query("replace_into", f"WITH s AS ({SOURCE}) SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s) UNION ALL SELECT * FROM s")
def _(spark, d):
    tables.attach(spark, d)
    return changes.replace_into(t(spark, d, "customer").select("c_custkey", "c_name"), spark.sql(SOURCE), "c_custkey")


@query("update_where", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'x' ELSE s_name END AS s_name FROM supplier")
def _(spark, d):
    return changes.update(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("s_nationkey") == 3, {"s_name": F.lit("x")}).select("s_suppkey", "s_name")


query("delete_where", "SELECT s_suppkey FROM supplier WHERE s_nationkey <> 3")(lambda spark, d: changes.delete(t(spark, d, "supplier"), F.col("s_nationkey") == 3).select("s_suppkey"))
query("foreign_key_violations", "SELECT o_custkey AS c FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 50)")(lambda spark, d: changes.violations(t(spark, d, "orders").select("o_custkey"), "o_custkey", t(spark, d, "customer").where("c_custkey > 50"), "c_custkey").select(F.col("o_custkey").alias("c")))
query("unique_violations", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")(lambda spark, d: changes.duplicates(t(spark, d, "orders"), ["o_custkey"]))
query("changeset", "SELECT c_custkey, CASE WHEN c_custkey <= 10 THEN 'delete' ELSE 'update' END AS op FROM customer WHERE c_custkey <= 10 OR c_nationkey = 4")(lambda spark, d: (lambda c: changes.changeset(c, c.where("c_custkey > 10").withColumn("c_name", F.when(F.col("c_nationkey") == 4, F.lit("y")).otherwise(F.col("c_name"))), "c_custkey").select("c_custkey", "op"))(t(spark, d, "customer")))

# --- retrieval
L2 = "round(sqrt(list_sum([power(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2) FOR i IN range(1, len(a.embedding) + 1)])), 6)"
QUERY = [0.1 * ((i * 7) % 5 - 2) for i in range(64)]
TO_QUERY = f"sqrt(list_sum([power(CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE), 2) FOR i IN range(1, 65)]))"
FROM_QUERY = f"(SELECT *, CAST({QUERY} AS DOUBLE[]) AS q FROM embeddings)"
query("vec_search", f"SELECT vec_id AS rowid, round({TO_QUERY}, 6) AS distance FROM {FROM_QUERY} ORDER BY {TO_QUERY}, vec_id LIMIT 10")(lambda spark, d: retrieval.search(t(spark, d, "embeddings"), "vec_id", "embedding", QUERY, 10).select("rowid", F.round("distance", 6).alias("distance")))
query("vec_search_filtered", f"SELECT vec_id AS rowid, round({TO_QUERY}, 6) AS distance FROM {FROM_QUERY} WHERE label = 3 ORDER BY {TO_QUERY}, vec_id LIMIT 10")(lambda spark, d: retrieval.search(t(spark, d, "embeddings"), "vec_id", "embedding", QUERY, 10, where=F.col("label") == 3).select("rowid", F.round("distance", 6).alias("distance")))
query("vec_range_search", f"SELECT vec_id AS rowid, round({TO_QUERY}, 6) AS distance FROM {FROM_QUERY} WHERE {TO_QUERY} <= 1.5")(lambda spark, d: retrieval.range_search(t(spark, d, "embeddings"), "vec_id", "embedding", QUERY, 1.5).select("rowid", F.round("distance", 6).alias("distance")))


@query("vec_search_join", f"SELECT query_rowid, rowid FROM (SELECT b.vec_id AS query_rowid, a.vec_id AS rowid, row_number() OVER (PARTITION BY b.vec_id ORDER BY {L2}, a.vec_id) AS r FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0) WHERE r <= 5")
def _(spark, d):
    e = t(spark, d, "embeddings")
    return retrieval.search_join(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5, digits=6).select("query_rowid", "rowid")


@query("vec_avg", "SELECT label, round(avg(embedding[1]), 5) AS first FROM embeddings GROUP BY label")
def _(spark, d):
    return retrieval.vec_average(t(spark, d, "embeddings"), ["label"], "embedding").select("label", F.round(F.col("centroid")[0], 5).alias("first"))


@query("fts_match", "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), 'license') AND NOT list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), 'apache')")
def _(spark, d):
    return t(spark, d, "documents").where(retrieval.matches(F.col("text"), "license NOT apache")).select("doc_id")


TF = "CAST(len([x FOR x IN t IF x = '{}']) AS DOUBLE)"


@query("bm25_corpus", "WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents), c AS (SELECT doc_id, len(t) AS n, " + TF.format("license") + " AS f FROM d), s AS (SELECT count(*) AS nd, avg(n) AS av, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS df FROM c) SELECT doc_id AS rowid, round(ln(1 + (nd - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av)), 6) AS score FROM c, s WHERE f > 0")
def _(spark, d):
    return retrieval.bm25(t(spark, d, "documents"), "doc_id", "text", "license").select("rowid", F.round("score", 6).alias("score"))


query("vec_hybrid_search")(lambda spark, d: retrieval.hybrid_search(t(spark, d, "embeddings"), "vec_id", "embedding", t(spark, d, "documents"), "doc_id", "text", QUERY, "license version", 20))
query("rtree_box", "SELECT p_partkey FROM part WHERE p_size <= 20 AND p_size >= 10 AND p_retailprice <= 1500 AND p_retailprice >= 1000")(lambda spark, d: t(spark, d, "part").where(retrieval.box_intersects(["p_size", "p_retailprice"], ["p_size", "p_retailprice"], [10, 1000], [20, 1500])).select("p_partkey"))

# --- streams
query("tumbling_window", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda spark, d: windows.tumbling(t(spark, d, "events")).select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n"))
query("session_window", "SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s) GROUP BY user_id")(lambda spark, d: windows.sessions(t(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events")))


# --- scalar functions: one query a function, over a table's column
def scalar(name: str, table: str, key: str, column, oracle: str) -> None:
    query(f"fn_{name.lower()}", f"SELECT {key}, {oracle} AS v FROM {table}")(lambda spark, d: t(spark, d, table).select(key, column().alias("v")))


c = F.col
_NAME, _BAL, _SIZE, _DATE = "c_name", "c_acctbal", "p_size", "o_orderdate"
for _n, _sql in {"UPPER": "upper(c_name)", "LOWER": "lower(c_name)", "LENGTH": "length(c_name)", "REVERSE": "reverse(c_name)", "ASCII": "ascii(c_name)", "TRIM": "trim(c_name)", "OCTET_LENGTH": "octet_length(CAST(c_name AS BLOB))", "HEX": "hex(c_name)", "INITCAP": "upper(c_name[1]) || lower(c_name[2:9]) || c_name[10:]", "QUOTE": "'''' || replace(c_name, '''', '''''') || ''''", "TYPEOF": "'text'"}.items():
    scalar(_n, "customer", "c_custkey", lambda n=_n: call(n, c(_NAME)), _sql)
for _n, _args, _sql in [
    ("SUBSTR", (2, 3), "substr(c_name, 2, 3)"), ("LEFT", (4,), "left(c_name, 4)"), ("RIGHT", (4,), "right(c_name, 4)"), ("LPAD", (25, "*"), "lpad(c_name, 25, '*')"), ("RPAD", (25, "*"), "rpad(c_name, 25, '*')"),
    ("REPLACE", ("0", "o"), "replace(c_name, '0', 'o')"), ("TRANSLATE", ("012", "abc"), "translate(c_name, '012', 'abc')"), ("INSTR", ("#",), "instr(c_name, '#')"), ("REPEAT", (2,), "repeat(c_name, 2)"), ("CONCAT", ("!",), "concat(c_name, '!')"),
    ("REGEXP_SUBSTR", ("[1-9]+",), "nullif(regexp_extract(c_name, '[1-9]+'), '')"), ("REGEXP_REPLACE", ("[0-9]+", "N"), "regexp_replace(c_name, '[0-9]+', 'N', 'g')"), ("REGEXP_LIKE", ("7$",), "regexp_matches(c_name, '7$')"), ("GLOB", ("*7?",), "c_name GLOB '*7?'"), ("RTRIM", ("0123456789",), "rtrim(c_name, '0123456789')"),
]:
    scalar(_n, "customer", "c_custkey", lambda n=_n, a=_args: call(n, c(_NAME), *a), _sql)
for _n, _sql in {"ABS": "abs(c_acctbal)", "FLOOR": "CAST(floor(c_acctbal) AS BIGINT)", "CEIL": "CAST(ceil(c_acctbal) AS BIGINT)", "SIGN": "CAST(sign(c_acctbal) AS INT)", "SQRT": "CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 8) END", "LN": "CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 8) END", "LOG": "CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 8) END", "LOG2": "CASE WHEN c_acctbal > 0 THEN round(log2(c_acctbal), 8) END", "SIN": "round(sin(c_acctbal), 8)", "COS": "round(cos(c_acctbal), 8)", "ATAN": "round(atan(c_acctbal), 8)", "CBRT": "round(cbrt(c_acctbal), 8)", "RADIANS": "round(radians(c_acctbal), 8)", "DEGREES": "round(degrees(c_acctbal), 5)", "TRUNC": "trunc(c_acctbal)", "ASIN": "CASE WHEN abs(c_acctbal) <= 1 THEN round(asin(c_acctbal), 8) END"}.items():
    _digits = None if _n in ("ABS", "FLOOR", "CEIL", "SIGN", "TRUNC") else 5 if _n == "DEGREES" else 8
    scalar(_n, "customer", "c_custkey", lambda n=_n, k=_digits: call(n, c(_BAL)) if k is None else F.round(call(n, c(_BAL)), k), _sql)
scalar("MOD", "part", "p_partkey", lambda: call("MOD", c(_SIZE), c("p_partkey") % 3), "CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size % (p_partkey % 3) END")
scalar("LEAST", "part", "p_partkey", lambda: call("LEAST", c(_SIZE), 10), "least(p_size, 10)")
scalar("GREATEST", "part", "p_partkey", lambda: call("GREATEST", c(_SIZE), 10), "greatest(p_size, 10)")
scalar("DECODE", "part", "p_partkey", lambda: call("DECODE", c(_SIZE), 1, "one", 2, "two", "more"), "CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'more' END")
scalar("NVL2", "part", "p_partkey", lambda: call("NVL2", F.nullif(c(_SIZE), F.lit(5)), "a", "b"), "CASE WHEN nullif(p_size, 5) IS NOT NULL THEN 'a' ELSE 'b' END")
scalar("BITAND", "part", "p_partkey", lambda: call("BITAND", c(_SIZE), 6), "p_size & 6")
scalar("BIT_COUNT", "part", "p_partkey", lambda: call("BIT_COUNT", c(_SIZE)), "CAST(bit_count(p_size) AS INT)")
for _n, _sql in {"YEAR": "year(o_orderdate)", "MONTH": "month(o_orderdate)", "DAY": "day(o_orderdate)", "DAYOFYEAR": "dayofyear(o_orderdate)", "DAYNAME": "dayname(o_orderdate)", "MONTHNAME": "monthname(o_orderdate)", "JULIANDAY": "epoch(o_orderdate) / 86400.0 + 2440587.5"}.items():
    scalar(_n, "orders", "o_orderkey", lambda n=_n: call(n, c(_DATE)), _sql)
scalar("LAST_DAY", "orders", "o_orderkey", lambda: call("LAST_DAY", c(_DATE)).cast("string"), "CAST(last_day(o_orderdate) AS VARCHAR)")
scalar("TO_CHAR", "orders", "o_orderkey", lambda: call("TO_CHAR", c(_DATE), "YYYY-MM-DD HH24:MI:SS"), "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')")
scalar("STRFTIME", "orders", "o_orderkey", lambda: call("STRFTIME", "%d/%m/%Y %H", c(_DATE)), "strftime(o_orderdate, '%d/%m/%Y %H')")
scalar("JSON_VALID", "events", "event_id", lambda: call("JSON_VALID", c("props")), "CAST(json_valid(props) AS INT)")
scalar("STANDARD_HASH", "customer", "c_custkey", lambda: call("STANDARD_HASH", c(_NAME), "MD5"), "upper(md5(c_name))")
assert FUNCTIONS
