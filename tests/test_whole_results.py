"""Whole rankings and whole hierarchies, beyond the bounds that once cut them."""

from pyspark.sql import functions as F

from basaltql.operators import hierarchy, retrieval


def test_hybrid_fuses_whole_rankings(spark):
    import math
    import random

    rng, n = random.Random(6), 300
    vectors = spark.createDataFrame([(i, [math.cos(i / 200), math.sin(i / 200)]) for i in range(n)], "id long, v array<double>")
    docs = spark.createDataFrame([(i, "word " * rng.randint(0, 20) + "filler " * rng.randint(1, 20)) for i in range(20, n + 20)], "id long, text string")
    scores = {r.rowid: r.score for r in retrieval.bm25(docs, "id", "text", "word").collect()}
    fused = {i: 1 / (61 + i) for i in range(n)}
    for place, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))):
        fused[i] = fused.get(i, 0.0) + 1 / (61 + place)
    for k in (10, 250):
        got = retrieval.hybrid_search(vectors, "id", "v", docs, "id", "text", [1.0, 0.0], "word", k).collect()
        expected = sorted(fused, key=lambda i: (-round(fused[i], 12), i))[:k]
        assert len(got) == k and [round(r.rrf_score, 12) for r in got] == [round(fused[i], 12) for i in expected]
        assert all(round(r.rrf_score, 12) == round(fused[r.rowid], 12) and r.bm25 == scores.get(r.rowid) for r in got)
    batch = retrieval.hybrid_search_batch(vectors, "id", "v", docs, "id", "text", [([1.0, 0.0], "word")], 250).collect()
    assert sorted(r.rowid for r in batch) == sorted(r.rowid for r in got)


def test_connect_by_reaches_every_level(spark):
    edges = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 71)], "id int, up int")
    got = hierarchy.connect_by(edges, "id", "up", F.col("up").isNull()).orderBy("level").collect()
    assert [(r.id, r.level, r.is_leaf, r.is_cycle) for r in got] == [(i, i, int(i == 70), 0) for i in range(1, 71)]
    assert got[-1].path == "".join(f"/{i}" for i in range(1, 71))
