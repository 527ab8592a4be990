"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are cut into shards, and shards into blocks of similar vectors. A block keeps its members as a small dense matrix
(the forward index) and each term's largest and smallest value. A query's bound for a block adds, for every term, the
larger product of its value with the two. Blocks are taken by falling bound; once a bound is below the query's k-th best
score so far, no later block can add to its result. Queries come in blocks as well, each of which meets every shard once;
a shard returns k rows a query at most, and only those that reach what a first look at a spread sample of the vectors has
shown to be in the top k for sure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spark_tools import bounded_batches, read, written

K, QUERY_EVERY, SCALE = 20, 20, 64
#: Vectors of a shard, of a block in it, and queries that meet a shard together: what a task holds. A vector is sent once for
#: QUERIES queries, a query once for SHARD vectors.
SHARD, BLOCK, QUERIES = 16384, 64, 32768
#: Queries that a shard's blocks are ordered for at once.
STEP = 1024


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(SCALE * x) of each component as 64-bit integers; vectors with a null or non-finite component are left out."""
    for batch in batches:
        vectors = batch.column("embedding")
        ids, out = [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), vectors, strict=True):
            if i is not None and v.is_valid and not v.values.null_count:
                x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vector"])


def matrix(blobs: list[bytes]) -> np.ndarray:
    """One row for each vector; shorter ones count as zero beyond their end, which changes no product."""
    width = max([len(b) // 8 for b in blobs], default=0)
    if all(len(b) == 8 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), width)
    out = np.zeros((len(blobs), width), np.int64)
    for row, b in zip(out, blobs, strict=True):
        row[: len(b) // 8] = np.frombuffer(b, "<i8")
    return out


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """Doubles hold the products exactly as long as no partial sum can reach 2**53."""
    top = lambda x: float(np.abs(x.astype(float)).max()) if x.size else 0.0
    return np.float64 if top(a) * top(b) * max(1, a.shape[1]) < 2.0**53 else np.int64


def clustered(x: np.ndarray) -> np.ndarray:
    """An order in which neighbours are similar: by the most similar of spread members, then by that similarity."""
    if not len(x):
        return np.zeros(0, np.int64)
    picks = x[np.linspace(0, len(x) - 1, max(1, min(len(x), int(len(x) ** 0.5)))).astype(int)].astype(float)
    near = x.astype(float) @ picks.T - 0.5 * (picks * picks).sum(1)
    return np.lexsort((-near.max(1), near.argmax(1)))


class Shard:
    """Vectors in blocks of similar ones, with each block's largest and smallest value of every term."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = clustered(x)
        self.ids, self.x = ids[order], x[order]
        self.starts = np.arange(0, len(x), BLOCK)
        self.high, self.low = np.maximum.reduceat(self.x, self.starts), np.minimum.reduceat(self.x, self.starts)

    def search(self, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's index, vec_id, score): each query's k best of the shard, ties to smaller ids, that score floor or more."""
        width = max(self.x.shape[1], q.shape[1])
        kind = exact_kind(self.x, q)
        x, high, low, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))).astype(kind) for m in (self.x, self.high, self.low, q))
        ids, starts = self.ids, self.starts
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        by_bound = np.argsort(-bounds, axis=1, kind="stable")
        out_q, out_id, out_s = [], [], []
        for i in range(len(q)):
            best_s, best_id, kth = np.zeros(0, kind), np.zeros(0, np.int64), floor[i]
            at = 0
            while at < len(starts) and bounds[i, by_bound[i, at]] >= kth:
                step = by_bound[i, at : at + 8]
                step = step[bounds[i, step] >= kth]
                at += 8
                rows = (starts[step][:, None] + np.arange(BLOCK)[None]).reshape(-1)
                rows = rows[rows < len(x)]
                s = x[rows] @ q[i]
                fit = (s >= kth) & (ids[rows] != query_ids[i])
                best_s, best_id = np.concatenate([best_s, s[fit]]), np.concatenate([best_id, ids[rows][fit]])
                keep = np.lexsort((best_id, -best_s))[:k]
                best_s, best_id = best_s[keep], best_id[keep]
                if len(keep) == k:
                    kth = max(kth, best_s[-1])
            out_q.append(np.full(len(best_s), i))
            out_id.append(best_id)
            out_s.append(best_s)
        return tuple(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in (out_q, out_id, out_s))


def _meeting(k: int):
    def run(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        if not members.empty and not queries.empty:
            shard = Shard(members["vec_id"].to_numpy(), matrix(members["vector"].tolist()))
            for at in range(0, len(queries), STEP):
                some = queries.iloc[at : at + STEP]
                ids = some["query_id"].to_numpy()
                floor = some["floor"].to_numpy(float) if "floor" in some else np.full(len(ids), -np.inf)
                i, vec, score = shard.search(ids, matrix(some["vector"].tolist()), floor, k)
                out.append(pd.DataFrame({"query_id": ids[i], "vec_id": vec, "score": score}))
        return pd.concat(out)

    return run


def top_k(vectors: DataFrame, query_every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by query_every its k best others (all, if fewer).

    vectors: (vec_id, embedding, any others). Scores are inner products of floor(64 * x); ties go to the smaller vec_id.
    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part. A vec_id that stands
    in several rows: each is a candidate of other queries, none of its own, and the first of equal rows asks. An empty table
    gives no rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    quantised = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_quantised, "vec_id long, vector binary"), "vectors")
    n = quantised.count()
    shards = max(1, -(-n // SHARD))
    asking = quantised.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector")).select(F.col("vec_id").alias("query_id"), "vector")
    blocks = max(1, -(-n // query_every // QUERIES))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    #: Rows are dealt out by number, so that no id and no frequent vector makes a shard large.
    members = quantised.withColumn("shard", F.pmod(F.monotonically_increasing_id() + F.shiftrightunsigned(F.monotonically_increasing_id(), 33), F.lit(shards)).cast("int"))

    def met(members: DataFrame, queries: DataFrame, count: int) -> DataFrame:
        left = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_meeting(k), "query_id long, vec_id long, score long")

    if shards > 2:
        #: The k-th best of any part of the vectors is a floor for the k-th best of all.
        sample = members.where("shard = 0")
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        floors = met(sample, asking, 1).withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        asking = asking.join(floors, "query_id", "left").fillna(-(2.0**62), ["floor"])
    found = met(members, asking, shards)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


#: Distinct embeddings of each table are whole vectors; DuckDB multiplies them as integers.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.x[i] * c.x[i] FOR i IN range(1, len(q.x) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
