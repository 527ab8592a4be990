"""Approximate vector indexes: inverted cells, sign projections, product codes, cells with codes of residuals, and graphs.

An index is a DataFrame with a column more, and what was learned, which is small and goes into the plan as literals. Cells and
code books are fitted by k-means on a sample of at most SAMPLE_ROWS rows; every row is indexed. A search ranks by the
approximate distance and looks at the best `rescore` times k rows exactly. The query's part is worked out on the driver."""

from __future__ import annotations

import dataclasses
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltql.operators.retrieval import l2sq, search, search_batch

#: Rows at most, in expectation, that centres and code books are fitted on; the bound holds the driver's part to some MB.
SAMPLE_ROWS = 20_000


def sampled(df: DataFrame, vector: str, seed: int = 1) -> np.ndarray:
    """Vectors of a random sample of the rows, as a matrix."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    n = rows.count()
    rows = rows.sample(SAMPLE_ROWS / n, seed) if n > SAMPLE_ROWS else rows
    return np.array([r.v for r in rows.collect()], dtype=float)


def centres(points: np.ndarray, k: int, seed: int = 1, rounds: int = 15) -> np.ndarray:
    """k-means by Lloyd's rounds from randomly chosen points; a centre without points stays where it is."""
    out = np.random.default_rng(seed).permutation(points)[:k].copy()
    for _ in range(rounds):
        own = _closest(points, out)
        for i in range(len(out)):
            if (own == i).any():
                out[i] = points[own == i].mean(0)
    return out


def _closest(points: np.ndarray, targets: np.ndarray) -> np.ndarray:
    return ((targets**2).sum(1) - 2 * points @ targets.T).argmin(1)


def _table(rows: list[list[float]]) -> Column:
    """A matrix as one literal."""
    return F.from_json(F.lit(str(rows)), "array<array<double>>")


def nearest(vector: Column, points: list[list[float]]) -> Column:
    """The number, from 0, of the nearest point; the first of equal ones."""
    return F.array_min(F.transform(_table(points), lambda c, i: F.struct(l2sq(c, vector).alias("d"), i.alias("i"))))["i"]


def _rescored(df: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str, rank: Column, rescore: int) -> DataFrame:
    return search(df.orderBy(rank, key).limit(k * rescore), key, vector, query, k, metric)


@dataclasses.dataclass
class Cells:
    """IVF: rows carry their nearest centre; a search reads the probes cells nearest to the query."""

    rows: DataFrame
    key: str
    vector: str
    points: list[list[float]]

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, cells: int) -> Cells:
        points = centres(sampled(df, vector), cells).tolist()
        return cls(df.withColumn("__cell", nearest(F.col(vector), points)), key, vector, points)

    def search(self, query: list[float], k: int, metric: str = "l2", probes: int = 8) -> DataFrame:
        order = np.argsort(((np.array(self.points) - query) ** 2).sum(1), kind="stable")[:probes]
        return search(self.rows.where(F.col("__cell").isin([int(i) for i in order])), self.key, self.vector, query, k, metric)


@dataclasses.dataclass
class Signs:
    """LSH: rows carry the signs of projections as bits of longs; the Hamming distance to the query's ranks them."""

    rows: DataFrame
    key: str
    vector: str
    planes: np.ndarray

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, dim: int, bits: int = 256, seed: int = 1) -> Signs:
        planes = np.random.default_rng(seed).normal(size=(bits, dim))
        products = F.transform(_table(planes.tolist()), lambda p: F.aggregate(F.zip_with(p, F.col(vector), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
        return cls(df.withColumn("__signs", F.transform(products, lambda x: x >= 0)), key, vector, planes)

    def search(self, query: list[float], k: int, metric: str = "l2", rescore: int = 10) -> DataFrame:
        own = F.from_json(F.lit(str([int(x >= 0) for x in self.planes @ np.array(query)])), "array<int>")
        apart = F.size(F.filter(F.zip_with("__signs", own, lambda a, b: a.cast("int") != b), lambda x: x))
        return _rescored(self.rows, self.key, self.vector, query, k, metric, apart, rescore)


def _parts(vector: Column, dim: int, parts: int) -> list[Column]:
    size = dim // parts
    return [F.slice(vector, i * size + 1, size) for i in range(parts)]


@dataclasses.dataclass
class Codes:
    """PQ, or with cells IVF-PQ: rows carry, for each part of the vector (less its cell's centre), the nearest code's number.

    A search sums the query's distances to the codes, a table worked out once for each cell it reads."""

    rows: DataFrame
    key: str
    vector: str
    books: list[list[list[float]]]
    points: list[list[float]]

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, dim: int, parts: int = 16, codes: int = 16, cells: int = 1) -> Codes:
        if dim % parts:
            raise ValueError("the parts must divide the dimension")
        known = sampled(df, vector)
        middle = centres(known, cells) if cells > 1 else np.zeros((1, dim))
        points = middle.tolist()
        rows = df.withColumn("__cell", nearest(F.col(vector), points) if cells > 1 else F.lit(0))
        rows = rows.withColumn("__left", F.zip_with(vector, F.element_at(_table(points), F.col("__cell") + 1), lambda a, b: a - b))
        known = known - middle[_closest(known, middle)]
        books = [centres(part, codes).tolist() for part in np.split(known, parts, axis=1)]
        held = F.array(*(nearest(p, b) for p, b in zip(_parts(F.col("__left"), dim, parts), books, strict=True)))
        return cls(rows.withColumn("__codes", held).drop("__left"), key, vector, books, points)

    def search(self, query: list[float], k: int, metric: str = "l2", probes: int = 8, rescore: int = 10) -> DataFrame:
        q, points = np.array(query), np.array(self.points)
        cells = np.argsort(((points - q) ** 2).sum(1), kind="stable")[:probes]
        costs: list[list] = [[] for _ in points]
        for c in cells:
            gaps = np.split(q - points[c], len(self.books))
            costs[c] = [((np.array(book) - gap) ** 2).sum(1).tolist() for book, gap in zip(self.books, gaps, strict=True)]
        held = F.element_at(F.from_json(F.lit(str(costs)), "array<array<array<double>>>"), F.col("__cell") + 1)
        rank = F.aggregate(F.zip_with("__codes", held, lambda code, cost: F.element_at(cost, code + 1)), F.lit(0.0), lambda a, b: a + b)
        return _rescored(self.rows.where(F.col("__cell").isin([int(c) for c in cells])), self.key, self.vector, query, k, metric, rank, rescore)


def recall(index, df: DataFrame, key: str, vector: str, queries: list[list[float]], k: int, metric: str = "l2", **options) -> float:
    """The mean share of the exact k nearest that the index finds. The indexed rows are kept while it is measured."""
    exact: dict[int, set] = {i: set() for i in range(len(queries))}
    for r in search_batch(df, key, vector, queries, k, metric).collect():
        exact[r.query_idx].add(r.rowid)
    if isinstance(index, Graph):
        #: Its shards are walked for all queries at once, as they are built; nothing needs to be kept.
        found = [set() for _ in queries]
        for r in index.search_batch(queries, k, metric, **options).collect():
            found[r.query_idx].add(r.rowid)
    else:
        kept = dataclasses.replace(index, rows=index.rows.persist())
        found = [{r.rowid for r in kept.search(q, k, metric, **options).collect()} for q in queries]
        kept.rows.unpersist()
    return sum(len(exact[i] & f) / max(len(exact[i]), 1) for i, f in enumerate(found)) / max(len(queries), 1)


#: Vectors of a graph's shard, which one task builds and searches; links of a node; the share of a level's nodes in the next.
GRAPH_ROWS, LINKS, UP = 4096, 16, 16


def _distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if metric == "inner_product":
        return -(x @ q)
    if metric == "cosine":
        size = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
        return 1 - np.divide(x @ q, size, out=np.zeros(len(x)), where=size > 0)
    square = ((x - q) ** 2).sum(1)
    return np.sqrt(square) if metric == "l2" else square


def graph_links(x: np.ndarray, links: int) -> np.ndarray:
    """Each node's neighbours in a navigable graph, -1 beyond their number: near nodes, none of which is nearer to another one
    that is kept than to the node, and the links back."""
    n, wide = len(x), min(len(x) - 1, 3 * links)
    square = (x**2).sum(1)
    out: list[list[int]] = [[] for _ in range(n)]
    for at in range(0, n, 64):
        gaps = square[at : at + 64, None] - 2 * x[at : at + 64] @ x.T + square[None]
        gaps[np.arange(len(gaps)), np.arange(at, at + len(gaps))] = np.inf
        near = np.argpartition(gaps, wide - 1, 1)[:, :wide] if wide else np.zeros((len(gaps), 0), int)
        for i, (row, some) in enumerate(zip(gaps, near, strict=True)):
            kept: list[int] = []
            for c in some[np.argsort(row[some], kind="stable")].tolist():
                if len(kept) == links:
                    break
                if not kept or (((x[kept] - x[c]) ** 2).sum(1) > row[c]).all():
                    kept.append(c)
            out[at + i] = kept
    back: list[list[int]] = [[] for _ in range(n)]
    for i, kept in enumerate(out):
        for c in kept:
            back[c].append(i)
    held = np.full((n, 2 * links), -1, np.int32)
    for i in range(n):
        every = list(dict.fromkeys([*out[i], *back[i]]))
        if len(every) > 2 * links:
            every = [every[j] for j in np.argsort(((x[every] - x[i]) ** 2).sum(1), kind="stable")[: 2 * links]]
        held[i, : len(every)] = every
    return held


def build_graph(x: np.ndarray, links: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, links) of each level, the lowest first: a level has a random share of the one below."""
    rng, members, levels = np.random.default_rng(seed), np.arange(len(x)), []
    while True:
        levels.append((members.astype(np.int32), graph_links(x[members], links)))
        if len(members) <= 2 * UP:
            return levels
        members = np.sort(rng.permutation(members)[: len(members) // UP])


def search_graph(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, k: int, width: int, metric: str) -> list[tuple[float, int]]:
    """(distance, node) of about the k nearest: from level to level to the nearest node, then the best `width` of the lowest."""
    at = 0
    for members, links in levels[:0:-1]:
        here = max(int(np.searchsorted(members, at)), 0)
        here = min(here, len(members) - 1)
        best = float(_distances(metric, x[members[[here]]], q)[0])
        while True:
            near = links[here][links[here] >= 0]
            gaps = _distances(metric, x[members[near]], q) if len(near) else np.zeros(0)
            if not len(near) or gaps.min() >= best:
                break
            here, best = int(near[gaps.argmin()]), float(gaps.min())
        at = int(members[here])
    links = levels[0][1]
    start = float(_distances(metric, x[[at]], q)[0])
    todo, found, seen = [(start, at)], [(-start, at)], {at}
    while todo:
        gap, node = heapq.heappop(todo)
        if len(found) >= width and gap > -found[0][0]:
            break
        near = [c for c in links[node].tolist() if c >= 0 and c not in seen]
        seen.update(near)
        for d, c in zip(_distances(metric, x[near], q).tolist() if near else [], near, strict=True):
            if len(found) < width or d < -found[0][0]:
                heapq.heappush(todo, (d, c))
                heapq.heappush(found, (-d, c))
                if len(found) > width:
                    heapq.heappop(found)
    return sorted((-d, c) for d, c in found)[:k]


@dataclasses.dataclass
class Graph:
    """HNSW: rows are dealt evenly to shards of about GRAPH_ROWS; each is one row that holds its vectors and a navigable graph of
    several levels. A search walks every shard's graph, in parallel, and takes the best of what they find."""

    rows: DataFrame
    key: str
    vector: str

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, links: int = LINKS, shard_rows: int = GRAPH_ROWS) -> Graph:
        held = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and id is not null")
        shards = max(1, -(-held.count() // shard_rows))

        def built(key, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("id")
            x = np.array(rows["v"].tolist(), float)
            levels = build_graph(x, links, int(key[0]))
            return pd.DataFrame({"shard": [key[0]], "dim": [x.shape[1]], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "members": [[m.tobytes() for m, _ in levels]], "links": [[n.tobytes() for _, n in levels]]})

        dealt = held.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        return cls(dealt.groupBy("shard").applyInPandas(built, "shard int, dim int, ids binary, vectors binary, members array<binary>, links array<binary>"), key, vector)

    def search_batch(self, queries: list[list[float]], k: int, metric: str = "l2", width: int = 64) -> DataFrame:
        """(query_idx, rowid, distance): about the k nearest of each query."""

        def walked(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    #: One shard of the batch at a time is copied out of Arrow.
                    row = pd.Series(batch.slice(i, 1).to_pylist()[0])
                    ids, x = np.frombuffer(row.ids, np.int64), np.frombuffer(row.vectors).reshape(-1, row.dim)
                    levels = [(np.frombuffer(m, np.int32), np.frombuffer(n, np.int32).reshape(len(m) // 4, -1)) for m, n in zip(row.members, row.links, strict=True)]
                    found = [(i, int(ids[c]), d) for i, q in enumerate(queries) for d, c in search_graph(x, levels, np.array(q, float), k, max(width, k), metric)]
                    at, id_, gap = zip(*found) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(id_, pa.int64()), pa.array(gap, pa.float64())], ["query_idx", "rowid", "distance"])

        near = self.rows.mapInArrow(walked, "query_idx int, rowid long, distance double")
        place = Window.partitionBy("query_idx").orderBy("distance", "rowid")
        return near.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= k).drop("__n")

    def search(self, query: list[float], k: int, metric: str = "l2", width: int = 64) -> DataFrame:
        return self.search_batch([query], k, metric, width).select("rowid", "distance").orderBy("distance", "rowid")
