"""Steps whose work must grow with their input, and values that must not depend on how rows are dealt."""

import time

from pyspark.sql import functions as F

from basaltql.operators import retrieval


def test_phrases_of_long_texts(spark):
    """Tokens are found once for a text, not once for each of its words."""
    texts = {0: "the end " * 60_000 + "The\n--answer", 1: "the_an the " * 60_000, 2: "the-an", 3: "bathe an the 2an", 4: "", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    at = time.monotonic()
    assert {r.id for r in docs.where(retrieval.matches(F.col("text"), '"the an"*')).collect()} == {0, 2}
    assert {r.id for r in docs.where(retrieval.matches(F.col("text"), '"the an" OR NOT the*')).collect()} == {2, 4}
    assert {r.rowid for r in retrieval.bm25(docs, "id", "text", '"the an"* "the end"').collect()} == {0}
    assert time.monotonic() - at < 60


def test_counts_of_greater_values_without_pairs(spark):
    """Whole counts, ties and nulls included, and no join but by equality of the values."""
    import random

    from basaltql.operators import frames
    from basaltql.plans import registry

    rng, nan = random.Random(2), float("nan")
    value = lambda: rng.choice([None, nan, 0.0, -0.0, *range(9)])
    own = [(i, rng.choice([None, 0, 1, 2]), value()) for i in range(80)]
    met = [(rng.choice([None, 0, 1]), value()) for _ in range(300)]
    kind = lambda rows: [tuple(float(x) if i == len(r) - 1 and x is not None else x for i, x in enumerate(r)) for r in rows]
    got = frames.count_greater(spark.createDataFrame(kind(own), "id int, g int, v double"), "g", "v", spark.createDataFrame(kind(met), "h int, w double"), "h", "w", "n").collect()
    place = lambda x: float("inf") if x != x else x
    assert {r.id: r.n for r in got} == {i: sum(h == g and None not in (g, v, w) and place(w) > place(v) for h, w in met) for i, g, v in own}
    plan = registry.queries()["outer_apply"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert " > " not in plan


def test_correlation_with_a_constant_over_many_parts(spark):
    from basaltql.operators import frames

    rows = spark.range(0, 20_000, 1, 13).select((F.col("id") % 7).alias("g"), F.lit(1.0).alias("one"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.0).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") * -2.0 + 0.1).alias("w"))
    got = rows.groupBy("g").agg(frames.corr_or_null("one", "v").alias("a"), frames.corr_or_null("v", "one").alias("b"), F.round(frames.corr_or_null("v", "w"), 9).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in got] == [(None, None, -1.0)] * 7


def test_numbers_are_rounded_as_in_c(spark):
    """Exact binary values, ties to even, where Java's format rounds the shortest decimal up."""
    import random

    from basaltql.functions.texts import to_char_number

    rng = random.Random(3)
    numbers = [0.125, 0.375, 1.005, 2.675, 2.5, 3.5, 0.995, 999.995, 0.0, -0.0, -0.001, 416850202583369.8, 2.0**53 + 2, 123456789012345678.0, 1e23, 4e37, float("nan"), float("inf"), float("-inf")]
    numbers += [rng.randrange(-(10**7), 10**7) / 1000 for _ in range(2000)] + [rng.uniform(-1e4, 1e4) for _ in range(500)] + [10 ** rng.uniform(-8, 37) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").repartition(1)
    for places in (0, 1, 2, 5, 12):
        got = df.select("x", to_char_number(F.col("x"), "FM9999999" + ("." + "9" * places if places else "")).alias("t")).collect()
        assert [r.t for r in got] == [f"{r.x:.{places}f}" for r in got]


def test_open_frames_run_from_their_open_end(spark):
    """No frame from a row to the end of its partition is left in the plan, as Spark works each of them out anew."""
    from basaltql.operators import frames

    rows = spark.createDataFrame([(0, 3, 5), (1, 3, 2), (2, 4, None), (3, 7, 1), (4, 7, 9), (5, 8, 2)], "i int, k int, v int")
    run = lambda agg, how, *frame: frames.excluding(rows, [], ["k", "i"] if frame else ["k"], "v", agg, how, "x", *frame)
    values = lambda df: [r.x for r in df.orderBy("i").collect()]
    assert values(run("min", "current row")) == [1, 1, 1, 2, 1, 1] and values(run("max", "current row")) == [9, 9, 9, 9, 5, 9]
    assert values(run("min", "group")) == [1, 1, 1, 2, 2, 1] and values(run("max", "ties")) == [9, 9, 9, 5, 9, 9]
    to_end = (-1, (1 << 63) - 1)
    assert values(run("sum", "current row", *to_end)) == [14, 17, 14, 11, 3, 9] and values(run("count", "group", *to_end)) == [4, 4, 4, 2, 2, 1]
    for df in (run("min", "current row"), run("max", "group"), run("max", "ties"), run("sum", "current row", *to_end)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing$()", "")


def test_vector_joins_hold_no_pairs(spark):
    """Every metric's nearest by brute force, with copies, nulls and other lengths; pairs aren't rows of the plan."""
    import math
    import random

    rng = random.Random(4)
    some = [[rng.choice([-1.0, 0.0, 0.5, rng.random()]) for _ in range(3)] for _ in range(60)]
    rows = [(i, some[i % 60] if i % 17 else None if i % 2 else [1.0]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, v array<float>").selectExpr("id", "cast(v as array<double>) as v")
    held = [(r.id, r.v) for r in df.collect()]

    def gap(metric, a, b):
        if a is None or b is None or len(a) != len(b):
            return None
        square, product = sum((x - y) ** 2 for x, y in zip(a, b)), sum(x * y for x, y in zip(a, b))
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return {"l2": math.sqrt(square), "l2sq": square, "inner_product": -product, "cosine": 1 - (product / size if size else 0.0)}[metric]

    for metric, digits in (("l2", None), ("l2", 1), ("l2sq", None), ("inner_product", None), ("cosine", None)):
        out = retrieval.search_join(df, "id", "v", df.where("id % 5 = 0"), "id", "v", 4, metric, blocks=3, digits=digits)
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        place = lambda d, n=digits: (d is None, d if n is None or d is None else math.floor(d * 10**n + 0.5))
        want = {i: [t for _, t in sorted((place(gap(metric, w, v)), t) for t, w in held)][:4] for i, v in held if i % 5 == 0}
        got = {}
        for r in sorted(out.collect(), key=lambda r: (place(r.distance), r.rowid)):
            got.setdefault(r.query_rowid, []).append(r.rowid)
        assert got == want, (metric, digits)
