"""Vector indexes against exact search, document sources and changes on small literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltql.operators import ann, changes, frames, hierarchy, retrieval
from basaltql.sources import documents

DIM, N = 16, 400


@pytest.fixture(scope="module")
def vectors(spark):
    points = np.random.default_rng(3).normal(size=(N, DIM))
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<float>").persist(), points[:5].tolist()


def test_cells(vectors):
    df, asked = vectors
    index = ann.Cells.build(df, "id", "v", 16)
    assert ann.recall(index, df, "id", "v", asked, 10, probes=8) >= 0.75
    assert ann.recall(index, df, "id", "v", asked, 10, probes=16) == 1.0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_signs(vectors, metric):
    df, asked = vectors
    assert ann.recall(ann.Signs.build(df, "id", "v", DIM), df, "id", "v", asked, 10, metric) >= 0.85


@pytest.mark.parametrize("cells", [1, 8])
def test_codes(vectors, cells):
    df, asked = vectors
    assert ann.recall(ann.Codes.build(df, "id", "v", DIM, 8, 16, cells), df, "id", "v", asked, 10, probes=8) >= 0.85


@pytest.mark.parametrize(("metric", "least"), [("l2", 0.9), ("cosine", 0.9), ("inner_product", 0.7)])
def test_graphs(vectors, metric, least):
    df, asked = vectors
    index = ann.Graph.build(df, "id", "v", shard_rows=150)
    assert ann.recall(index, df, "id", "v", asked, 10, metric, width=32) >= least
    assert index.search(asked[0], 1).first().rowid == 0


def test_graph_of_few_rows(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [0.0, 0.0]), (3, None)], "id long, v array<double>")
    assert [r.rowid for r in ann.Graph.build(few, "id", "v").search([1.0, 2.0], 5).collect()] == [1, 2]
    assert ann.Graph.build(few.where("id > 5"), "id", "v").search([1.0, 2.0], 5).count() == 0


def test_parts_divide_the_dimension(vectors):
    with pytest.raises(ValueError):
        ann.Codes.build(vectors[0], "id", "v", DIM, 5)


def test_batches_equal_single_searches(vectors):
    df, asked = vectors
    batch = retrieval.search_batch(df, "id", "v", asked, 3).orderBy("query_idx", "distance").collect()
    for i, q in enumerate(asked):
        assert [r.rowid for r in batch if r.query_idx == i] == [r.rowid for r in retrieval.search(df, "id", "v", q, 3).collect()]
    near = {(r.query_idx, r.rowid) for r in retrieval.range_search_batch(df, "id", "v", asked, 4.0).collect()}
    assert near == {(i, r.rowid) for i, q in enumerate(asked) for r in retrieval.range_search(df, "id", "v", q, 4.0).collect()}


def test_box_join_has_each_pair_once(spark):
    a = spark.createDataFrame([(1, -5.0, 25.0), (2, 9.0, 9.5)], "a int, lo double, hi double")
    b = spark.createDataFrame([(1, 0.0, 30.0), (2, 9.5, 9.5), (3, 26.0, 40.0)], "b int, lo2 double, hi2 double")
    got = retrieval.box_join(a, b, "lo", "hi", "lo2", "hi2", 10.0).select("a", "b").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_json_table_nested_rows_stay(spark):
    df = spark.createDataFrame([(1, '{"rows":[{"a":"1","in":[{"b":2},{"b":3}]},{"a":"x"}]}'), (2, "no json"), (3, None)], "id int, doc string")
    got = documents.json_table(df, "doc", "$.rows[*]", [documents.Field("n", ordinality=True), documents.Field("a", "int", default=-1), documents.Nested("$.in[*]", [documents.Field("b", "int")])])
    assert sorted((r.id, r.n, r.a, r.b) for r in got.collect() if r.b) == [(1, 1, 1, 2), (1, 1, 1, 3)]
    assert [(r.n, r.a) for r in got.collect() if r.b is None] == [(2, -1)]


def test_xmltable_keeps_elements_whole(spark):
    df = spark.createDataFrame([(1, "<l><i k='1'><n>a</n></i><i k='2'/></l>"), (2, "<bad"), (3, None)], "id int, doc string")
    got = documents.xmltable(df, "doc", "/l/i", {"k": ("@k", "int"), "n": ("n", "string")}).collect()
    assert [(r.id, r.k, r.n) for r in got] == [(1, 1, "a"), (1, 2, None)]


def test_sequence_has_no_gaps(spark):
    got = changes.next_values(spark.range(1000, numPartitions=7).withColumn("o", -F.col("id")), ["o"], start=10, step=2).orderBy("nextval").collect()
    assert [r.nextval for r in got] == list(range(10, 2010, 2))
    assert [r.id for r in got] == list(range(999, -1, -1))


def test_log_keeps_the_last_entry(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    log = spark.createDataFrame([(1, 5, "delete", (1, "a")), (1, 6, "insert", (1, "z")), (2, 9, "delete", (2, "b")), (3, 1, "insert", (3, "c"))], "k int, lsn int, op string, after struct<k:int,s:string>")
    assert sorted(map(tuple, changes.apply_log(base, log, "k").collect())) == [(1, "z"), (3, "c")]


def test_recursion_that_never_ends_is_an_error(spark):
    with pytest.raises(ValueError):
        hierarchy.recursive_distinct(spark.range(1), lambda new: new.select((F.col("id") + 1).alias("id")), most_rounds=4)


def test_json_group_object_writes_nulls(spark):
    df = spark.createDataFrame([("b", None), ('a"', 1)], "k string, v int")
    assert df.agg(frames.json_group_object("k", "v").alias("v")).first().v == '{"a\\"":1,"b":null}'
