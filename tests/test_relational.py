import os

from pyspark.sql import functions as F

from basaltql.functions.scalar import call
from basaltql.operators import changes, frames, hierarchy, retrieval
from basaltql.sources import tables
from basaltql.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_dialect_rules(spark):
    assert one(spark, call("LOG", 100.0)) == 2.0
    assert one(spark, call("MOD", 7, 0)) == 7
    assert one(spark, call("%", 7, 0)) is None
    assert one(spark, call("LEAST", F.lit(None).cast("int"), 1)) is None
    assert one(spark, call("SUBSTR", "hello", 0, 2)) == "h"
    assert one(spark, call("SUBSTR", "hello", -3, 2)) == "ll"
    assert one(spark, call("||", F.lit(None).cast("string"), "a")) == "a"
    assert one(spark, call("INITCAP", "o'brien-smith x")) == "O'Brien-Smith X"
    assert one(spark, call("CHR", 8364)) == "€"
    assert one(spark, call("SOUNDEX", F.lit(None).cast("string"))) == "?000"
    assert str(one(spark, call("ADD_MONTHS", F.lit("2023-02-28").cast("date"), 1))) == "2023-03-31"


def test_groups_frame(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3)], "g int, k int")
    got = frames.groups_frame(df, ["g"], "k", -1, 0, F.sum("k"), "v").orderBy("k").collect()
    assert [r.v for r in got] == [1, 5, 5, 7]


def test_connect_by_stops_at_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "id int, p int")
    got = hierarchy.connect_by(df, "id", "p", F.col("id") == 1).orderBy("level").collect()
    assert [(r.id, r.level, r.is_cycle) for r in got] == [(1, 1, 0), (2, 2, 1)]


def test_match_recognize(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 3, 2), (1, 4, 9)], "g int, id int, v int")
    got = hierarchy.match_recognize(df, ["g"], ["id"], {"A": F.col("v") < 8, "B": F.col("v") >= 8}, "A+ B", {"n": ("A", "v", "count"), "top": ("B", "v", "last")}).collect()
    assert [(r.n, r.top) for r in got] == [(3, 9)]


def test_merge_deletes_and_inserts(spark):
    t, s = (spark.createDataFrame(rows, "id int, v int") for rows in ([(1, 10), (2, 20)], [(2, 0), (3, 30)]))
    got = changes.merge(t, s, "id", {"v": F.col("s.v")}, delete=F.col("s.v") == 0)
    assert sorted(map(tuple, got.collect())) == [(1, 10), (3, 30)]


def test_full_text_grammar(spark):
    df = spark.createDataFrame([(1, "red fox jumps"), (2, "red dog"), (3, "foxes")], "id int, body string")
    ids = lambda q: sorted(r.id for r in df.where(retrieval.matches(F.col("body"), q)).collect())
    assert ids("red NOT fox") == [2]
    assert ids('"red fox" OR fox*') == [1, 3]
    assert ids("(dog OR jumps) AND red") == [1, 2]


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    for kind in ("parquet", "json", "csv", "orc"):
        tables.save(df, f"{tmp_path}/{kind}", kind)
        assert [tuple(r) for r in tables.load(spark, f"{tmp_path}/{kind}", "k int, s string", kind).collect()] == [(1, "a")]
    (tmp_path / "v.csv").write_text('id,vec\n1,"[1.0, 2.0]"\n')
    assert tables.import_vectors(spark, str(tmp_path / "v.csv"), "id", "vec").first().vector == [1.0, 2.0]


def test_stream_gives_the_tables_rows(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    rows = spark.read.parquet(path)
    os.makedirs(f"{tmp_path}/in")
    rows.write.parquet(f"{tmp_path}/in/e")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
    q = windows.tumbling(stream, late="365 days").writeStream.outputMode("complete").format("memory").queryName("tumbling_test").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbling_test").collect())) == sorted(map(tuple, windows.tumbling(rows).collect()))
