"""Queries in the dialect's own words, further clauses, tables' definitions and user functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltql.dialect import rewrite
from basaltql.functions.scalar import call
from basaltql.operators import changes, definitions, frames, hierarchy, retrieval
from basaltql.plans.catalogue import EDGES, sql, t
from basaltql.plans.registry import query
from basaltql.sources import tables
from basaltql.streaming import windows

c = F.col


def dialect(name: str, text: str, oracle: str, **variables) -> None:
    """A query in the dialect, and its SQL."""
    names = tuple(n for n in tables.TABLES if re.search(rf"\b{n}\b", text))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.attach(spark, sf_dir, names=names)
        return rewrite.run(spark, text, variables)

    query(name, oracle)(run)


# constructs that are rewritten
_BALANCES = "SELECT c_acctbal FROM customer WHERE c_nationkey = 3"
for _name, _op, _bound in [("any", "> ANY", "> (SELECT min(c_acctbal)"), ("some", "<= SOME", "<= (SELECT max(c_acctbal)"), ("all", ">= ALL", ">= (SELECT max(c_acctbal)"), ("less_all", "<= ALL", "<= (SELECT min(c_acctbal)")]:
    dialect(f"compare_{_name}", f"SELECT s_suppkey FROM supplier WHERE s_acctbal {_op} ({_BALANCES})", f"SELECT s_suppkey FROM supplier WHERE s_acctbal {_bound} FROM customer WHERE c_nationkey = 3)")
dialect("compare_equal_any", "SELECT c_custkey FROM customer WHERE c_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
dialect("compare_unequal_all", "SELECT c_custkey FROM customer WHERE c_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
dialect("compare_any_list", "SELECT p_partkey FROM part WHERE p_size = ANY (3, 7, 11) AND p_size <> ALL (7, 8)", "SELECT p_partkey FROM part WHERE p_size IN (3, 11)")
dialect("compare_all_of_none", "SELECT count(*) AS n FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = -1)", "SELECT count(*) AS n FROM supplier")
dialect("outer_join_mark", "SELECT n.n_name, s.s_suppkey FROM nation n, supplier s WHERE n.n_nationkey = s.s_nationkey(+) AND s.s_acctbal(+) > 5000 AND n.n_regionkey < 3", "SELECT n.n_name, s.s_suppkey FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000 WHERE n.n_regionkey < 3")
dialect("rownum_limit", "SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey) WHERE ROWNUM <= 7", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
dialect("rownum_filter", "SELECT count(*) AS n FROM (SELECT 1 AS x FROM customer WHERE c_nationkey < 20 AND ROWNUM < 6)", "SELECT 5 AS n")
dialect("minus", "SELECT c_nationkey AS k FROM customer MINUS SELECT s_nationkey FROM supplier WHERE s_suppkey < 5", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 5")
dialect("literals", "SELECT q'[it's \\ here]' AS a, N'x' AS b, X'4142' AS c, DATE '2024-02-29' AS d, 'a''b' AS e FROM DUAL", "SELECT 'it''s \\ here' AS a, 'x' AS b, CAST('AB' AS BLOB) AS c, DATE '2024-02-29' AS d, 'a''b' AS e")
dialect("interval_literals", "SELECT o_orderkey, o_orderdate + INTERVAL '1' DAY + INTERVAL '2' MONTH AS v FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY + INTERVAL 2 MONTH AS v FROM orders")
dialect("user_variables", "SELECT c_custkey FROM customer WHERE c_nationkey <= @nation AND c_mktsegment = @segment", "SELECT c_custkey FROM customer WHERE c_nationkey <= 3 AND c_mktsegment = 'BUILDING'", nation=3, segment="BUILDING")
dialect("limit_comma", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5, 4", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 4 OFFSET 5")
dialect("fetch_first", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 3 ROWS FETCH NEXT 4 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 4 OFFSET 3")
dialect("sample_rows", "SELECT count(*) > 0 AS some FROM lineitem SAMPLE (50)", "SELECT true AS some")

# clauses that Spark has
sql("order_nulls_last", "SELECT c_custkey, v FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS v FROM customer) ORDER BY v DESC NULLS LAST, 1 LIMIT 40")
sql("order_nulls_first", "SELECT c_custkey, v FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS v FROM customer) ORDER BY v NULLS FIRST, c_custkey LIMIT 12")
sql("order_by_aggregate", "SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 5")
sql("like_escape", "SELECT count(*) AS n FROM (SELECT c_name || '_' || c_mktsegment AS v FROM customer) WHERE v LIKE '%1!_%' ESCAPE '!'")
sql("regexp_operator", "SELECT c_custkey FROM customer WHERE c_name RLIKE '[13]{2}$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[13]{2}$')")
sql("join_anti_exists_rows", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 3000)")
sql("join_anti_not_in_rows", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 6)")
sql("row_subquery", "SELECT c_custkey FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT c_nationkey, max(c_mktsegment) FROM customer GROUP BY c_nationkey)")
sql("window_last_ignore_nulls", "SELECT c_custkey, last_value(nullif(c_mktsegment, 'BUILDING')) IGNORE NULLS OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS v FROM customer", "SELECT c_custkey, last_value(nullif(c_mktsegment, 'BUILDING') IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS v FROM customer")
sql("window_first_ignore_nulls", "SELECT c_custkey, first_value(nullif(c_mktsegment, 'BUILDING')) IGNORE NULLS OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS v FROM customer", "SELECT c_custkey, first_value(nullif(c_mktsegment, 'BUILDING') IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS v FROM customer")
sql("index_hint", "SELECT /*+ BROADCAST(n) */ n_name, count(*) AS n FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY n_name")

query("fetch_with_ties", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")(lambda spark, d: frames.fetch_ties(t(spark, d, "part").select("p_partkey", "p_size"), [("p_size", True)], 10))
query("rownum_numbers", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) AS INT) AS rownum FROM customer ORDER BY c_custkey LIMIT 9")(lambda spark, d: frames.rownum(t(spark, d, "customer").select("c_custkey"), 9, [c("c_custkey")]))
query("agg_keep_dense_rank_last", "SELECT c_nationkey, max(c_custkey) AS k, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC) AS r FROM customer) WHERE r = 1 GROUP BY c_nationkey")(
    lambda spark, d: frames.keep_dense_rank(t(spark, d, "customer"), ["c_nationkey"], F.desc("c_mktsegment"), [F.max("c_custkey").alias("k"), F.count("*").alias("n")])
)
query("agg_corr_constant", "SELECT p_brand, CASE WHEN var_pop(1) = 0 THEN NULL ELSE 1.0 END AS v FROM part GROUP BY p_brand")(lambda spark, d: t(spark, d, "part").withColumn("one", F.lit(1.0)).groupBy("p_brand").agg(frames.corr_or_null("one", "p_size").alias("v")))
for _n in ("json", "jsonb"):
    query(f"agg_{_n}_group_array", "SELECT n_regionkey, '[' || string_agg(CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE 'null' END, ',' ORDER BY n_nationkey) || ']' AS v FROM nation GROUP BY n_regionkey")(
        lambda spark, d: t(spark, d, "nation").withColumn("x", F.when(c("n_nationkey") % 2 == 0, c("n_nationkey"))).groupBy("n_regionkey").agg(frames.json_group_array("x", "n_nationkey").alias("v"))
    )
query("agg_jsonb_group_object", """SELECT '{' || string_agg('"' || r_name || '":' || r_regionkey, ',' ORDER BY r_name) || '}' AS v FROM region""")(lambda spark, d: t(spark, d, "region").agg(frames.json_group_object("r_name", "r_regionkey").alias("v")))
query("unpivot_include_nulls", "SELECT c_custkey, m, v FROM (SELECT c_custkey, 'a' AS m, nullif(c_mktsegment, 'BUILDING') AS v FROM customer UNION ALL SELECT c_custkey, 'b', c_name FROM customer)")(
    lambda spark, d: frames.unpivot(t(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("a"), c("c_name").alias("b")), ["a", "b"], "m", "v", nulls=True).select("c_custkey", "m", "v")
)
query("vec_avg_all", "SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(embedding) GROUP BY label, i")(
    lambda spark, d: retrieval.vec_average(t(spark, d, "embeddings"), ["label"], "embedding").select("label", F.posexplode("centroid").alias("i", "v")).select("label", (c("i") + 1).cast("long").alias("i"), F.round("v", 5).alias("v"))
)
for _metric, _distance in {"inner_product": "-list_dot_product({a}, {b})", "cosine": "1 - list_cosine_similarity({a}, {b})", "l2sq": "list_distance({a}, {b}) ** 2"}.items():
    _d = _distance.format(a="CAST(e.embedding AS DOUBLE[])", b="CAST(q.embedding AS DOUBLE[])")
    query(f"vec_search_{_metric}", f"SELECT e.vec_id AS rowid, round({_d}, 5) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round({_d}, 9), e.vec_id LIMIT 10")(
        lambda spark, d, m=_metric: retrieval.search(t(spark, d, "embeddings"), "vec_id", "embedding", list(map(float, t(spark, d, "embeddings").where("vec_id = 0").first().embedding)), 10, m).withColumn("distance", F.round("distance", 5))
    )
query("rtree_box_rows", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_partkey BETWEEN 5 AND 5000")(lambda spark, d: t(spark, d, "part").where(retrieval.box_intersects(["p_size", "p_partkey"], ["p_size", "p_partkey"], [10, 5], [20, 5000])).select("p_partkey"))
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
query("fts_phrase_prefix", f"SELECT doc_id FROM documents WHERE len(list_filter(range(1, len({_TOKENS})), lambda i: {_TOKENS}[i] = 'the' AND starts_with({_TOKENS}[i + 1], 'an'))) > 0")(lambda spark, d: t(spark, d, "documents").where(retrieval.matches(c("text"), '"the an"*')).select("doc_id"))
query("bm25_prefix_not", f"WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), c AS (SELECT doc_id, len(t) AS n, CAST(len([x FOR x IN t IF starts_with(x, 'lic')]) AS DOUBLE) AS f, len([x FOR x IN t IF x = 'warranty']) AS g FROM d), s AS (SELECT count(*) AS nd, avg(n) AS av, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS df FROM c) SELECT doc_id AS rowid, round(ln(1 + (nd - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av)), 6) AS score FROM c, s WHERE f > 0 AND g = 0")(
    lambda spark, d: retrieval.bm25(t(spark, d, "documents"), "doc_id", "text", "lic* NOT warranty").withColumn("score", F.round("score", 6))
)


# hierarchies and patterns
def _tree(spark, d):
    tables.attach(spark, d)
    return hierarchy.connect_by(spark.sql(EDGES.replace("AS VARCHAR", "AS STRING")), "id", "up", c("up").isNull(), siblings="id")


_TREE = f"WITH RECURSIVE e AS ({EDGES}), h AS (SELECT id, 1 AS level, [id] AS place FROM e WHERE up IS NULL UNION ALL SELECT e.id, h.level + 1, list_append(h.place, e.id) FROM e JOIN h ON e.up = h.id)"
query("order_siblings_by", f"{_TREE} SELECT id, row_number() OVER (ORDER BY place) AS place FROM h")(lambda spark, d: hierarchy.depth_first(_tree(spark, d)).select("id", "place"))
query("search_breadth_first", f"{_TREE} SELECT id, row_number() OVER (ORDER BY level, place) AS place FROM h")(lambda spark, d: hierarchy.breadth_first(_tree(spark, d)).select("id", "place"))
query("cycle_clause", "SELECT * FROM (VALUES (1, '/1', 0), (2, '/1/2', 0), (3, '/1/2/3', 1)) v(id, path, is_cycle)")(
    lambda spark, d: hierarchy.connect_by(spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id int, up int"), "id", "up", c("id") == 1).select("id", "path", "is_cycle")
)
_RUNS = "WITH l AS (SELECT user_id, event_id, row_number() OVER w AS r, CASE WHEN value > lag(value) OVER w THEN 1 ELSE 0 END AS up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, r - row_number() OVER (PARTITION BY user_id, up ORDER BY r) AS g FROM l)"
query("match_all_rows", f"{_RUNS} SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, g ORDER BY r) AS INT) AS row_in_match, 'UP' AS classifier FROM g WHERE up = 1")(
    lambda spark, d: hierarchy.match_rows(t(spark, d, "events").withColumn("up", F.coalesce(c("value") > F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(False))), ["user_id"], ["ts", "event_id"], {"UP": c("up")}, "UP+", ["event_id"]).select("user_id", "event_id", "row_in_match", "classifier")
)
query("match_alternatives", "SELECT count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE a IN ('click', 'view') AND b = 'purchase'")(
    lambda spark, d: hierarchy.match_recognize(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], {"C": c("event_type") == "click", "V": c("event_type") == "view", "P": c("event_type") == "purchase"}, "(C | V) P", {"p": ("P", "event_id", "first")}).agg(F.count("*").alias("n"))
)

# changes
_NEW = "SELECT c_custkey + 100 AS c_custkey, 'new' || i AS c_name, i FROM customer, (SELECT 1 AS i UNION ALL SELECT 2) x WHERE c_custkey <= 200"


def _doubled(spark, d):
    tables.attach(spark, d, names=("customer",))
    return t(spark, d, "customer").select("c_custkey", "c_name"), spark.sql(_NEW)


query("upsert_ignore_repeated", f"WITH s AS ({_NEW}) SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM s WHERE i = 1 AND c_custkey NOT IN (SELECT c_custkey FROM customer)")(lambda spark, d: (lambda held, new: changes.insert_or_ignore(held, new, "c_custkey", "i"))(*_doubled(spark, d)))
query("replace_into_repeated", f"WITH s AS ({_NEW}) SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s) UNION ALL SELECT c_custkey, c_name FROM s WHERE i = 2")(lambda spark, d: (lambda held, new: changes.replace_into(held, new, "c_custkey", "i"))(*_doubled(spark, d)))
query("update_limit", "SELECT s_suppkey, CASE WHEN row_number() OVER (ORDER BY CASE WHEN s_nationkey > 5 THEN 0 ELSE 1 END, s_acctbal, s_suppkey) <= 4 AND s_nationkey > 5 THEN 'x' ELSE s_name END AS s_name FROM supplier")(
    lambda spark, d: changes.update(t(spark, d, "supplier"), c("s_nationkey") > 5, {"s_name": F.lit("x")}, "s_suppkey", ["s_acctbal"], 4).select("s_suppkey", "s_name")
)
query("delete_limit", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 5 ORDER BY s_acctbal DESC, s_suppkey LIMIT 3)")(
    lambda spark, d: changes.delete(t(spark, d, "supplier"), c("s_nationkey") > 5, "s_suppkey", [F.desc("s_acctbal")], 3).select("s_suppkey")
)
query("update_subquery", "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_regionkey FROM nation")(
    lambda spark, d: changes.update_from(t(spark, d, "nation").select("n_nationkey", c("n_regionkey").cast("long").alias("n_regionkey")), t(spark, d, "nation").select("n_nationkey").join(t(spark, d, "supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")), "n_nationkey", "left").fillna(0), "n_nationkey", {"n_regionkey": c("s.n")})
)
query("merge_delete_where", "SELECT c_custkey, 'new' AS c_name FROM customer WHERE c_custkey <= 50 AND c_nationkey >= 10 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey > 50")(
    lambda spark, d: changes.merge(t(spark, d, "customer"), t(spark, d, "customer").where("c_custkey <= 50").select("c_custkey"), "c_custkey", {"c_name": F.lit("new")}, c("t.c_nationkey") < 10).select("c_custkey", "c_name")
)
query("truncate", "SELECT * FROM region WHERE false")(lambda spark, d: changes.truncate(t(spark, d, "region")))
query("check_violations", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END + CASE WHEN c_nationkey >= 20 THEN 1 ELSE 0 END AS n FROM customer WHERE c_acctbal < 0 OR c_nationkey >= 20")(
    lambda spark, d: changes.check_violations(t(spark, d, "customer"), {"balance": c("c_acctbal") >= 0, "nation": c("c_nationkey") < 20}, ["c_custkey"]).select("c_custkey", F.size("violations").alias("n"))
)
query("sequence_cycle", "SELECT c_custkey, CAST(CASE WHEN r < 3 THEN 5 + 2 * r ELSE 1 + 2 * ((r - 3) % 5) END AS BIGINT) AS nextval FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer)")(lambda spark, d: changes.Sequence(5, 2, 1, 10, cycle=True).nextval(t(spark, d, "customer").select("c_custkey"), ["c_custkey"]))


@query("sequence_currval", "SELECT 10 * count(*) AS v FROM nation")
def _(spark, d):
    numbers = changes.Sequence(10, 10)
    numbers.nextval(t(spark, d, "nation"), ["n_nationkey"])
    return spark.range(1).select(numbers.currval().cast("long").alias("v"))


# definitions
query("alter_table", "SELECT CAST(r_regionkey AS VARCHAR) AS key, upper(r_name) AS name, 7 AS extra FROM region")(
    lambda spark, d: definitions.rename(definitions.modify(definitions.add(t(spark, d, "region").withColumn("r_name", F.upper("r_name")), "extra", "int", 7), "r_regionkey", "string"), {"r_regionkey": "key", "r_name": "name"}).select("key", "name", "extra")
)
query("drop_column", "SELECT c_custkey, c_name FROM customer")(lambda spark, d: definitions.drop(t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_acctbal"))
query("generated_column", "SELECT c_custkey, c_custkey * 2 AS twice FROM customer")(lambda spark, d: definitions.generated(t(spark, d, "customer").select("c_custkey"), "twice", "c_custkey * 2"))
query("create_view", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")(lambda spark, d: definitions.view(spark, "v_regions", t(spark, d, "nation"), "SELECT n_regionkey, count(*) AS n FROM {source} GROUP BY n_regionkey"))
query("materialized_view", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")(lambda spark, d: definitions.materialized(t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))))
query("user_tables", "SELECT * FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) v(table_name)")(lambda spark, d: definitions.user_tables(spark, d).select("table_name"))
query("user_tab_columns", "SELECT table_name, column_name, CAST(ordinal_position AS INT) AS column_id FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'orders', 'events')")(lambda spark, d: definitions.user_tab_columns(spark, d).where("table_name IN ('region', 'nation', 'customer', 'supplier', 'orders', 'events')").select("table_name", "column_name", "column_id"))
query("explain", "SELECT true AS scanned")(lambda spark, d: definitions.explain(t(spark, d, "nation").where("n_regionkey = 1")).select((F.max(F.contains("plan", F.lit("Scan parquet")))).alias("scanned")))

# user functions
query("user_scalar_function", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part")(lambda spark, d: definitions.with_functions(spark, {"twice_and_one(x INT) RETURNS INT": "x * 2 + 1"}, {"part": t(spark, d, "part")}, "SELECT p_partkey, twice_and_one(p_size) AS v FROM part"))
query("user_table_function", "SELECT n_nationkey, k FROM nation, (SELECT unnest(range(1, 4)) AS k) WHERE k <= n_nationkey % 3 + 1")(
    lambda spark, d: definitions.with_functions(spark, {"upto(n INT) RETURNS TABLE (k INT)": "SELECT id FROM (SELECT explode(sequence(1, n)) AS id)"}, {"nation": t(spark, d, "nation")}, "SELECT n_nationkey, k FROM nation, LATERAL upto(n_nationkey % 3 + 1)")
)
query("user_aggregate", "SELECT p_brand, round(exp(avg(ln(p_size))), 6) AS v FROM part GROUP BY p_brand")(lambda spark, d: t(spark, d, "part").groupBy("p_brand").agg(F.round(definitions.aggregate("ln(x)", "avg", "exp(x)")("p_size"), 6).alias("v")))

# sources
query("table_collection", "SELECT unnest([n_nationkey, n_regionkey]) AS column_value FROM nation")(lambda spark, d: tables.collection(t(spark, d, "nation"), F.array("n_nationkey", "n_regionkey")))
query("blob_read", "SELECT c_custkey, CAST(substr(c_name, 3, 4) AS BLOB) AS v FROM customer")(lambda spark, d: t(spark, d, "customer").select("c_custkey", tables.blob_read(c("c_name").cast("binary"), 2, 4).alias("v")))


@query("attach_detach", "SELECT a.n_nationkey FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey")
def _(spark, d):
    tables.attach(spark, d, "other_", ("nation",))
    tables.attach(spark, d, names=("nation",))
    out = spark.sql("SELECT a.n_nationkey FROM nation a JOIN other_nation b ON a.n_nationkey = b.n_regionkey")
    tables.detach(spark, "other_", ("nation",))
    return out


@query("key_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def _(spark, d):
    return tables.key_range(t(spark, d, "orders"), "o_orderkey", 100, 200).select("o_orderkey", "o_totalprice")


query("stream_tumbling_window", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda spark, d: windows.streamed(spark, d, "events.parquet", windows.tumbling).select(F.unix_seconds(c("start").cast("timestamp")).alias("start"), "event_type", "n"))
query("fn_overlaps_period", "SELECT count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND TIMESTAMP '1995-01-01' < o_orderdate + INTERVAL 30 DAY")(
    lambda spark, d: t(spark, d, "orders").where(call("__OVERLAPS", c("o_orderdate"), c("o_orderdate") + F.make_dt_interval(days=F.lit(30)), F.lit("1995-01-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp"))).agg(F.count("*").alias("n"))
)
