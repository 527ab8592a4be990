"""The rewriter on texts, and operators on small tables against results worked out by hand."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from basaltql.dialect import rewrite
from basaltql.functions.formats import cast
from basaltql.functions.scalar import call
from basaltql.operators import changes, definitions, frames, hierarchy, retrieval


def value(spark, sql, **variables):
    return rewrite.run(spark, sql, variables).first()[0]


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("SELECT q'{a}b}' FROM dual", "a}b"),
        ("SELECT 'back\\slash' FROM DUAL -- a comment", "back\\slash"),
        ("SELECT 'it''s' /* and\nanother */", "it's"),
        ("SELECT 3 > ANY (1, 5)", True),
        ("SELECT 3 > ALL (1, 5)", False),
        ("SELECT 3 = SOME (SELECT 3 FROM dual)", True),
        ("SELECT 3 > ANY (SELECT x FROM (VALUES (1), (NULL)) v(x))", True),
        ("SELECT 0 > ANY (SELECT x FROM (VALUES (1), (NULL)) v(x))", None),
        ("SELECT 3 > ALL (SELECT x FROM (VALUES (1), (NULL)) v(x))", None),
        ("SELECT 0 > ALL (SELECT x FROM (VALUES (1), (NULL)) v(x))", False),
        ("SELECT 0 > ALL (SELECT x FROM (VALUES (1)) v(x) WHERE x > 5)", True),
        ("SELECT 0 > ANY (SELECT x FROM (VALUES (1)) v(x) WHERE x > 5)", False),
        ("SELECT count(*) FROM (SELECT 1 FROM range(10) WHERE id BETWEEN 2 AND 8 AND ROWNUM < 4)", 3),
        ("SELECT @n + 1", 8),
        ('SELECT "a b" FROM (SELECT 1 AS "a b")', 1),
    ],
)
def test_rewritten(spark, sql, expected):
    assert value(spark, sql, n=7) == expected


def test_outer_join_marks(spark):
    for name, rows in (("ta", "(1), (2) AS t(k)"), ("tb", "(1, 'x') AS t(k, v)"), ("tc", "(2, 'y') AS t(k, w)")):
        spark.sql(f"SELECT * FROM VALUES {rows}").createOrReplaceTempView(name)
    got = rewrite.run(spark, "SELECT a.k, b.v, c.w FROM ta a, tb b, tc c WHERE a.k = b.k(+) AND c.k(+) = a.k AND a.k > 0").collect()
    assert sorted(tuple(r) for r in got) == [(1, "x", None), (2, None, "y")]


def test_errors():
    for sql in ("SELECT q'[open", "SELECT x FROM t WHERE a.k(+) = b.k(+)", "SELECT k, count(*) FROM t WHERE ROWNUM < 3 GROUP BY k"):
        with pytest.raises(ValueError):
            rewrite.translate(sql)


def test_excluding_frames(spark):
    rows = spark.createDataFrame([(1, 10), (1, 20), (2, 30), (2, None), (3, 50)], "k int, v int")
    run = lambda agg, how, *frame: [r.x for r in frames.excluding(rows, [], ["k"], "v", agg, how, "x", *frame).orderBy("k", F.col("v").asc_nulls_last()).collect()]
    assert run("sum", "group") == [80, 80, 80, 80, 60]
    assert run("count", "current row") == [3, 3, 3, 4, 3]
    assert run("sum", "current row", 0, 0) == [None] * 5
    one = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    bounded = lambda agg, how: [r.x for r in frames.excluding(one, [], ["k"], "v", agg, how, "x", -1, 0).orderBy("k").collect()]
    assert bounded("sum", "group") == [None, 10, 20] and bounded("count", "group") == [0, 1, 1] and bounded("max", "ties") == [10, 20, 30] and bounded("min", "current row") == [None, 10, 20]
    with pytest.raises(ValueError):
        frames.excluding(one, [], ["k"], "v", "min", "group", "x", -1)


def test_row_patterns(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate("ABABBCA")], "p int, i int, k string")
    define = {x: F.col("k") == x for x in "ABC"}
    run = lambda pattern, v="A": [tuple(r)[1:] for r in hierarchy.match_recognize(rows, ["p"], ["i"], define, pattern, {"first": (v, "i", "first"), "n": (v, "i", "count")}).orderBy("match_number").collect()]
    assert run("(A B)+ A") == [(1, 0, 2)]
    assert run("(A | B)+ C", "B") == [(1, 1, 3)]
    assert run("B*", "B") == [(1, 1, 1), (2, 3, 2)]
    assert run("A B{2}") == [(1, 2, 1)]
    for bad in ("A ^ B", "A D", "{- A -}"):
        with pytest.raises(ValueError):
            run(bad)
    many = {f"V{i}": F.col("i") == i for i in range(40)}
    got = hierarchy.match_recognize(rows, ["p"], ["i"], many, "V3 V4", {"n": ("V4", "i", "first")}).collect()
    assert [r.n for r in got] == [4]


def test_chains_of_computed_columns(spark):
    edges = spark.range(20).selectExpr("id", "if(id = 0, null, id - 1) up")
    assert hierarchy.connect_by(edges, "id", "up", F.col("up").isNull()).agg(F.max("level")).first()[0] == 20


def test_repeated_keys(spark):
    held = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 2), (2, "d", 3), (2, "e", 1)], "k int, v string, at int")
    assert sorted(map(tuple, changes.insert_or_ignore(held, new, "k", "at").collect())) == [(1, "a"), (2, "e")]
    assert sorted(map(tuple, changes.replace_into(held, new, "k", "at").collect())) == [(1, "b"), (2, "d")]


def test_sequences(spark):
    s = changes.Sequence(3, -2, -4, 5, cycle=True)
    first = [r.v for r in s.nextval(spark.range(6), ["id"], "v").orderBy("id").collect()]
    assert first == [3, 1, -1, -3, 5, 3]
    assert spark.range(1).select(s.currval()).first()[0] == 3
    assert [r.v for r in s.nextval(spark.range(2), ["id"], "v").orderBy("id").collect()] == [1, -1]
    with pytest.raises(Exception, match="exhausted"):
        changes.Sequence(1, 1, most=2).nextval(spark.range(3), ["id"]).collect()


def test_full_text_grammar(spark):
    texts = spark.createDataFrame([(1, "red fox jumps"), (2, "red dog"), (3, "foxes are red"), (4, "the red foxes")], "id int, text string")
    hits = lambda q: {r.id for r in texts.where(retrieval.matches(F.col("text"), q)).collect()}
    assert hits('"red fox"') == {1} and hits('"red fox"*') == {1, 4} and hits("red NOT fox*") == {2} and hits("dog OR jumps") == {1, 2} and hits("red -dog (fox OR foxes)") == {1, 3, 4}
    ranked = lambda q: {r.rowid for r in retrieval.bm25(texts, "id", "text", q).collect()}
    assert ranked("fox*") == {1, 3, 4} and ranked("red NOT fox") == {2, 3, 4} and ranked('"red fox"*') == {1, 4} and ranked("dog jumps") == {1, 2}


def test_function_arguments(spark):
    row = spark.range(1).select(
        call("INSTR", "abcabc", "bc", -1, 1).alias("back"), call("INSTR", "abcabc", "bc", -3, 1).alias("back3"), call("INSTR", "abc", "z", 1, 1).alias("none"),
        call("REGEXP_INSTR", "x12y345", "[0-9]+", 1, 2, 1).alias("after"), call("REGEXP_REPLACE", "a1b2", "([a-z])([0-9])", r"\2\1", 1, 2).alias("second"),
        call("TO_DATE", "29-FEB-24", "DD-MON-RR").cast("string").alias("rr"), call("TO_TIMESTAMP", "x", "YYYY").alias("bad"), call("DATE", 2460000.5).alias("julian"),
        cast(F.lit("12.345"), "NUMBER(5,2)").cast("string").alias("number"), cast(F.lit("123456.7"), "NUMBER(5,2)").alias("wide"), call("PRINTF", "%05.1f|%-4s|%q", 3.14159, "ab", "o'x").alias("printed"),
        call("STRFTIME", "%H:%M", "2024-01-31 10:20:30", "+1 hour").alias("moved"), call("JSON_VALID", '{"a":1} x').alias("trailing"),
    ).first()
    assert row == Row(back=5, back3=2, none=0, after=8, second="a12b", rr="2024-02-29", bad=None, julian="2023-02-25", number="12.35", wide=None, printed="003.1|ab  |o''x", moved="11:20", trailing=0)


def test_limits_with_ties(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 7), (5, 5)], "k int, v int")
    keys = lambda order, n: {r.k for r in frames.fetch_ties(rows, order, n).collect()}
    assert keys([("v", True)], 2) == {4, 1, 2, 5} and keys([("v", False)], 1) == {3} and keys([("v", False), ("k", True)], 2) == {3, 5}


def test_definitions(spark):
    rows = spark.range(3)
    assert definitions.add(rows, "x", "int", 1).columns == ["id", "x"]
    with pytest.raises(ValueError):
        definitions.add(rows, "id", "int")
    with pytest.raises(ValueError):
        definitions.drop(rows, "nothing")
