"""Further queries: documents as rows, changes, hierarchies, vector batches and indexes, functions of texts and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from basaltql.functions.json_text import json_tree
from basaltql.functions.scalar import call
from basaltql.functions.texts import to_char_number
from basaltql.operators import ann, changes, frames, hierarchy, retrieval
from basaltql.plans.catalogue import scalar, sql, t
from basaltql.plans.registry import query
from basaltql.sources import documents

c = F.col

# aggregates and grouping
sql("agg_any_value", "SELECT n_regionkey, any_value(r_name) AS v FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
sql("agg_string_agg", "SELECT c_nationkey, string_agg(c_mktsegment, ';') WITHIN GROUP (ORDER BY c_custkey) AS v FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(c_mktsegment, ';' ORDER BY c_custkey) AS v FROM customer GROUP BY c_nationkey")
sql("agg_approx_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS v FROM lineitem GROUP BY l_returnflag")
sql("agg_approx_percentile", "SELECT l_returnflag, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS v FROM lineitem GROUP BY l_returnflag")
sql("agg_total_group", "SELECT count(*) AS n, max(c_acctbal) AS v FROM customer GROUP BY GROUPING SETS (())", "SELECT count(*) AS n, max(c_acctbal) AS v FROM customer")
sql("agg_grouping_id", "SELECT c_mktsegment, c_nationkey, grouping_id(c_mktsegment, c_nationkey) AS g, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
sql("agg_having_alone", "SELECT count(*) AS n FROM customer HAVING count(*) > 1")
sql("agg_group_by_alias", "SELECT c_nationkey % 5 AS k, count(*) AS n FROM customer GROUP BY k")
sql("agg_distinct_filter", "SELECT o_orderstatus, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS n FROM orders GROUP BY o_orderstatus")
query("agg_json_group_object", """SELECT '{' || string_agg('"' || r_name || '":' || r_regionkey, ',' ORDER BY r_name) || '}' AS v FROM region""")(lambda spark, d: t(spark, d, "region").agg(frames.json_group_object("r_name", "r_regionkey").alias("v")))
query("pivot_xml", "SELECT DISTINCT c_mktsegment, '<PivotSet></PivotSet>' AS pivot_xml FROM customer")(lambda spark, d: frames.pivot_xml(t(spark, d, "customer"), ["c_mktsegment"]))
query("window_nth_from_last", "SELECT c_custkey, nth_value(c_name, 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM customer")(
    lambda spark, d: t(spark, d, "customer").select("c_custkey", frames.nth_from_last("c_name", 2, ["c_nationkey"], [F.desc("c_custkey")]).alias("v"))
)
sql("window_filter", "SELECT o_orderkey, count(CASE WHEN o_totalprice > 100000 THEN 1 END) OVER (PARTITION BY o_custkey) AS n FROM orders")
sql("window_offset_frame", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS v FROM orders")

# predicates and joins
sql("row_value_compare", "SELECT c_custkey FROM customer WHERE struct(c_nationkey, c_custkey) > struct(12, 100L)", "SELECT c_custkey FROM customer WHERE (c_nationkey, c_custkey) > (12, 100)")
sql("collate_nocase", "SELECT count(*) AS n FROM customer WHERE c_mktsegment COLLATE UTF8_LCASE = 'building'", "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'")
sql("cross_apply", "SELECT n_nationkey, x.top FROM nation, LATERAL (SELECT max(c_acctbal) AS top FROM customer WHERE c_nationkey = n_nationkey HAVING max(c_acctbal) > 0) x", "SELECT n_nationkey, max(c_acctbal) AS top FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey HAVING max(c_acctbal) > 0")
query("outer_apply", "SELECT s_suppkey, (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > s_acctbal) AS n FROM supplier")(
    lambda spark, d: frames.count_greater(t(spark, d, "supplier"), "s_nationkey", "s_acctbal", t(spark, d, "customer"), "c_nationkey", "c_acctbal", "n").select("s_suppkey", "n")
)
sql("join_self", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("correlated_exists_aggregate", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
query("bind_parameters", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9")(lambda spark, d: spark.sql("SELECT p_partkey FROM {part} WHERE p_size BETWEEN :lo AND :hi", args={"lo": 5, "hi": 9}, part=t(spark, d, "part")))
query("box_join", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal <= s_acctbal + 25 AND c_acctbal + 10 >= s_acctbal")(
    lambda spark, d: retrieval.box_join(
        t(spark, d, "customer").select("c_custkey", c("c_acctbal").alias("lo"), (c("c_acctbal") + 10).alias("hi")),
        t(spark, d, "supplier").select("s_suppkey", c("s_acctbal").alias("other_lo"), (c("s_acctbal") + 25).alias("other_hi")), "lo", "hi", "other_lo", "other_hi", 50.0,
    ).select("c_custkey", "s_suppkey")
)

# documents as rows
query("json_tree", "SELECT event_id, '$' AS fullkey, 'object' AS type FROM events UNION ALL SELECT event_id, '$.k', 'integer' FROM events")(lambda spark, d: json_tree(t(spark, d, "events").select("event_id", "props"), "props").select("event_id", "fullkey", "type"))


def _region_documents(spark, d, item, whole):
    return t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), c("n_regionkey") == c("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(item)).alias("__items")).select("r_regionkey", whole.alias("doc"))


@query("json_table_nested", "SELECT r_name AS region, n_nationkey AS nation, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS nr, n_name AS name, 1 AS has_name, 7 AS more FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    docs = _region_documents(spark, d, F.struct("n_nationkey", "n_name"), F.to_json(F.struct("r_name", c("__items").alias("nations"))))
    field = documents.Field
    inner = [field("nr", ordinality=True), field("nation", "int", "$.n_nationkey"), field("name", path="$.n_name"), field("has_name", path="$.n_name", exists=True), field("more", "int", "$.absent", default=7)]
    return documents.json_table(docs, "doc", "$", [field("region", path="$.r_name"), documents.Nested("$.nations[*]", inner)]).drop("r_regionkey", "doc")


@query("xmltable", "SELECT r_regionkey, n_nationkey AS nation, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    item = F.concat(F.lit('<nation key="'), c("n_nationkey").cast("string"), F.lit('"><name>'), c("n_name"), F.lit("</name></nation>"))
    docs = _region_documents(spark, d, item, F.concat(F.lit("<region>"), F.array_join("__items", ""), F.lit("</region>")))
    return documents.xmltable(docs, "doc", "/region/nation", {"nation": ("@key", "int"), "name": ("name", "string")}).drop("doc")


# changes
query("upsert_update", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 26, n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 1")(
    lambda spark, d: changes.upsert(t(spark, d, "nation"), t(spark, d, "nation").withColumn("n_nationkey", F.when(c("n_nationkey") % 2 == 1, c("n_nationkey") + 26).otherwise(c("n_nationkey"))), "n_nationkey", {"n_name": F.concat(F.upper("s.n_name"), F.lit("!"))})
)
query("update_from", "SELECT s_suppkey, n_name AS s_name, s_nationkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey")(
    lambda spark, d: changes.update_from(t(spark, d, "supplier"), t(spark, d, "nation").select(c("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", {"s_name": c("s.n_name")})
)
for _first in (False, True):
    _when = "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'rest' END"
    query("insert_first" if _first else "insert_all", f"SELECT c_custkey, {_when} AS target FROM customer" if _first else "SELECT c_custkey, 'debt' AS target FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'low' FROM customer WHERE c_acctbal < 5000 UNION ALL SELECT c_custkey, 'rest' FROM customer WHERE c_acctbal >= 5000")(
        lambda spark, d, f=_first: _joined(changes.insert_all(t(spark, d, "customer"), {"debt": c("c_acctbal") < 0, "low": c("c_acctbal") < 5000}, f, "rest"))
    )


def _joined(parts):
    out = [df.select("c_custkey", F.lit(n).alias("target")) for n, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


query("delete_returning", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")(lambda spark, d: changes.returning(t(spark, d, "customer"), c("c_acctbal") < 0, [c("c_custkey"), c("c_name")]))
query("sequence_nextval", "SELECT c_custkey, 100 + 5 * (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) AS nextval FROM customer")(lambda spark, d: changes.next_values(t(spark, d, "customer"), ["c_acctbal", "c_custkey"], start=100, step=5).select("c_custkey", "nextval"))


@query("change_log_apply", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'new' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey % 3 <> 0")
def _(spark, d):
    nation = t(spark, d, "nation")
    entry = lambda lsn, op, name: nation.select("n_nationkey", F.lit(lsn).alias("lsn"), F.lit(op).alias("op"), F.struct("n_nationkey", name.alias("n_name"), "n_regionkey").alias("after"))
    log = entry(1, "update", F.lit("old")).where("n_nationkey % 3 <> 2").unionByName(entry(2, "delete", c("n_name")).where("n_nationkey % 3 = 0")).unionByName(entry(3, "update", F.lit("new")).where("n_nationkey % 3 = 1"))
    return changes.apply_log(nation, log, "n_nationkey")


# hierarchies
query("connect_by_level", "SELECT CAST(i AS INT) AS level FROM range(1, 13) r(i)")(lambda spark, d: hierarchy.level_rows(spark, 12))
query("recursive_union_distinct", "WITH RECURSIVE r(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey < 3 UNION SELECT (k * 7 + 1) % 25 FROM r) SELECT k FROM r")(
    lambda spark, d: hierarchy.recursive_distinct(t(spark, d, "nation").where("n_nationkey < 3").select(c("n_nationkey").alias("k")), lambda new: new.select(((c("k") * 7 + 1) % 25).cast("int").alias("k")))
)

# vectors: batches, filters and indexes
_Q = ([0.5] * 64, [-0.25] * 64)


def _fit(spark, d):
    """The given query vectors cut to the table's dimension."""
    dim = t(spark, d, "embeddings").select(F.size("embedding").alias("n")).first().n
    return [list(q[:dim]) + [0.0] * max(0, dim - len(q)) for q in _Q], dim


def _duck_distance(value: str) -> str:
    return f"round(list_distance(CAST(embedding AS DOUBLE[]), list_transform(embedding, lambda x: CAST({value} AS DOUBLE))), 6)"


_BATCH = " UNION ALL ".join("SELECT {i} AS query_idx, rowid, distance FROM (SELECT vec_id AS rowid, {dist} AS distance FROM embeddings {where} ORDER BY list_distance(CAST(embedding AS DOUBLE[]), list_transform(embedding, lambda x: CAST({v} AS DOUBLE))), vec_id LIMIT 5)".format(i=i, v=q[0], dist=_duck_distance(str(q[0])), where="{where}") for i, q in enumerate(_Q))
for _name, _where in {"vec_search_batch": None, "vec_search_filtered_batch": "label = 1"}.items():
    query(_name, _BATCH.format(where=f"WHERE {_where}" if _where else ""))(
        lambda spark, d, w=_where: retrieval.search_batch(t(spark, d, "embeddings"), "vec_id", "embedding", _fit(spark, d)[0], 5, where=F.expr(w) if w else None).withColumn("distance", F.round("distance", 6))
    )
query("vec_range_search_batch", " UNION ALL ".join(f"SELECT {i} AS query_idx, vec_id AS rowid, {_duck_distance(str(q[0]))} AS distance FROM embeddings WHERE list_distance(CAST(embedding AS DOUBLE[]), list_transform(embedding, lambda x: CAST({q[0]} AS DOUBLE))) <= 4" for i, q in enumerate(_Q)))(
    lambda spark, d: retrieval.range_search_batch(t(spark, d, "embeddings"), "vec_id", "embedding", _fit(spark, d)[0], 4.0).withColumn("distance", F.round("distance", 6))
)
query("vec_search_join_filtered", "SELECT query_rowid, rowid FROM (SELECT q.vec_id AS query_rowid, e.vec_id AS rowid, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS n FROM embeddings q JOIN embeddings e ON e.label = 2 WHERE q.vec_id % 100 = 0) WHERE n <= 3")(
    lambda spark, d: retrieval.search_join_filtered(t(spark, d, "embeddings"), "vec_id", "embedding", t(spark, d, "embeddings").where("vec_id % 100 = 0"), "vec_id", "embedding", 3, c("label") == 2).select("query_rowid", "rowid")
)
query("vec_sum", "SELECT label, i, round(sum(CAST(embedding[i] AS DOUBLE)), 4) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(embedding) GROUP BY label, i")(
    lambda spark, d: retrieval.vec_sum(t(spark, d, "embeddings"), ["label"], "embedding").select("label", F.posexplode("total").alias("i", "v")).select("label", (c("i") + 1).cast("long").alias("i"), F.round("v", 4).alias("v"))
)
query("vec_hybrid_search_batch")(lambda spark, d: retrieval.hybrid_search_batch(t(spark, d, "embeddings"), "vec_id", "embedding", t(spark, d, "documents"), "doc_id", "text", [(q, w) for q, w in zip(_fit(spark, d)[0], ("the", "data"), strict=True)], 5))


#: The graph is searched so widely that it finds the exact neighbours.
_HNSW = " UNION ALL ".join(f"SELECT {i} AS query_idx, rowid FROM (SELECT vec_id AS rowid FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), list_transform(embedding, lambda x: CAST({q[0]} AS DOUBLE))), vec_id LIMIT 5)" for i, q in enumerate(_Q))
query("vec_search_hnsw", _HNSW)(lambda spark, d: ann.Graph.build(t(spark, d, "embeddings"), "vec_id", "embedding").search_batch(_fit(spark, d)[0], 5, width=400).select("query_idx", "rowid"))


@query("vector_analyze")
def _(spark, d):
    """Recall of each kind of index, for ten stored vectors."""
    df, dim = t(spark, d, "embeddings").where("embedding is not null"), _fit(spark, d)[1]
    asked = [list(map(float, r.embedding)) for r in df.orderBy("vec_id").limit(10).collect()]
    kinds = {"ivf": (ann.Cells.build(df, "vec_id", "embedding", 16), {"probes": 13}), "lsh": (ann.Signs.build(df, "vec_id", "embedding", dim), {}), "pq": (ann.Codes.build(df, "vec_id", "embedding", dim), {}), "ivfpq": (ann.Codes.build(df, "vec_id", "embedding", dim, cells=16), {"probes": 14, "rescore": 15}), "hnsw": (ann.Graph.build(df, "vec_id", "embedding"), {})}
    rows = [(n, 10, len(asked), float(ann.recall(i, df, "vec_id", "embedding", asked, 10, **o))) for n, (i, o) in kinds.items()]
    return spark.createDataFrame(rows, "kind string, k int, sample_size int, mean_recall double")


# functions
for _n, _column, _sql in [
    ("JSON_SET", lambda: call("JSON_SET", c("props"), "$.z", c("event_type")), "CAST(json_merge_patch(props, json_object('z', event_type)) AS VARCHAR)"),
    ("JSON_INSERT", lambda: call("JSON_INSERT", c("props"), "$.k", 0, "$.n", 1), "CAST(json_merge_patch(props, '{\"n\":1}') AS VARCHAR)"),
    ("JSON_REPLACE", lambda: call("JSON_REPLACE", c("props"), "$.k", 0, "$.n", 1), "CAST(json_merge_patch(props, '{\"k\":0}') AS VARCHAR)"),
    ("JSON_REMOVE", lambda: call("JSON_REMOVE", c("props"), "$.k"), "CAST(json_merge_patch(props, '{\"k\":null}') AS VARCHAR)"),
    ("JSON_PATCH", lambda: call("JSON_PATCH", c("props"), '{"k":{"b":1}}'), "CAST(json_merge_patch(props, '{\"k\":{\"b\":1}}') AS VARCHAR)"),
    ("JSON_TYPE", lambda: call("JSON_TYPE", c("props"), "$.k"), "CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN 'integer' END"),
    ("JSON_OBJECT", lambda: call("JSON_OBJECT", "id", c("event_id"), "t", c("event_type")), "CAST(json_object('id', event_id, 't', event_type) AS VARCHAR)"),
    ("JSON_QUOTE", lambda: call("JSON_QUOTE", c("event_type")), "'\"' || event_type || '\"'"),
]:
    scalar(_n, "events", "event_id", _column, _sql)
for _n, _column, _sql in [
    ("DATE", lambda: call("DATE", c("o_orderdate"), "start of month", "+1 month", "-1 day"), "CAST(CAST(last_day(o_orderdate) AS DATE) AS VARCHAR)"),
    ("DATETIME", lambda: call("DATETIME", c("o_orderdate"), "+90 minutes"), "strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S')"),
    ("TIME", lambda: call("TIME", c("o_orderdate"), "+30 seconds"), "strftime(o_orderdate + INTERVAL 30 SECOND, '%H:%M:%S')"),
    ("EXTRACT", lambda: call("EXTRACT", "QUARTER", c("o_orderdate")), "CAST(quarter(o_orderdate) AS INT)"),
    ("FROM_TZ", lambda: call("FROM_TZ", F.date_format("o_orderdate", "yyyy-MM-dd"), "+01:00"), "strftime(o_orderdate, '%Y-%m-%d') || '+01:00'"),
    ("AT_TIME_ZONE", lambda: call("__AT_TIME_ZONE", c("o_orderdate"), "-02:30"), "strftime(o_orderdate - INTERVAL 150 MINUTE, '%Y-%m-%d %H:%M:%S')"),
    ("NUMTOYMINTERVAL", lambda: F.date_format(c("o_orderdate") + call("NUMTOYMINTERVAL", 2, "MONTH"), "yyyy-MM-dd"), "strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m-%d')"),
    ("FROM_UNIXTIME", lambda: call("FROM_UNIXTIME", c("o_orderkey") * 1000), "strftime(make_timestamp(o_orderkey * 1000000000), '%Y-%m-%d %H:%M:%S')"),
]:
    scalar(_n, "orders", "o_orderkey", _column, _sql)
for _n, _column, _sql in [
    ("ASCIISTR", lambda: call("ASCIISTR", c("c_name")), "c_name"),
    ("UNISTR", lambda: call("UNISTR", c("c_name")), "c_name"),
    ("DUMP", lambda: call("DUMP", c("c_mktsegment")), "'Len=' || length(c_mktsegment) || ': ' || array_to_string(list_transform(string_split(c_mktsegment, ''), lambda x: CAST(ascii(x) AS VARCHAR)), ',')"),
    ("ORA_HASH", lambda: call("ORA_HASH", c("c_name"), 99), "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(c_name || '|0', ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 100"),
    ("XMLFOREST", lambda: call("XMLFOREST", "n", c("c_name"), "k", c("c_custkey")), "'<n>' || c_name || '</n><k>' || c_custkey || '</k>'"),
    ("TO_CHAR_NUMBER", lambda: to_char_number(c("c_acctbal"), "FM9999999.99"), "printf('%.2f', c_acctbal)"),
]:
    scalar(_n, "customer", "c_custkey", _column, _sql)
scalar("FTS5_TF", "documents", "doc_id", lambda: call("FTS5_TF", c("text"), "the"), "coalesce(len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: x = 'the')), 0)")
for _n, _column, _sql in [
    ("VEC_DIM", lambda: call("VEC_DIM", c("embedding")), "CAST(len(embedding) AS INT)"),
    ("VEC_LENGTH", lambda: call("VEC_LENGTH", c("embedding")), "CAST(len(embedding) * 4 AS INT)"),
    ("VEC_NORM", lambda: F.round(call("VEC_NORM", c("embedding")), 6), "round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6)"),
    ("VEC_L2SQ", lambda: F.round(call("VEC_L2SQ", c("embedding"), call("VEC_ADD", c("embedding"), c("embedding"))), 6), "round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6)"),
    ("VEC_SLICE", lambda: call("VEC_DIM", call("VEC_SLICE", c("embedding"), 2, 5)), "CAST(len(embedding[3:5]) AS INT)"),
    ("VEC_COSINE_SIM", lambda: F.round(call("VEC_COSINE_SIM", c("embedding"), F.reverse("embedding")), 6), "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6)"),
]:
    scalar(_n, "embeddings", "vec_id", _column, _sql)
