"""Vector and full-text retrieval: exact k-NN, range search, joins of queries and vectors, BM25 and hybrid ranking."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .changes import next_values

#: BM25's saturation and length weights, and the constant of reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


METRICS = {"l2": lambda a, b: F.sqrt(l2sq(a, b)), "l2sq": l2sq, "inner_product": lambda a, b: -dot(a, b), "cosine": lambda a, b: 1 - cosine_similarity(a, b)}


def literal(vector: list[float]) -> Column:
    """A vector as one constant: Catalyst folds the text into an array when it plans."""
    return F.from_json(F.lit(json.dumps([float(x) for x in vector])), "array<double>")


def search(df: DataFrame, id_column: str, vector: str, query: list[float], k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """(rowid, distance): the k nearest, ties to the smaller id. where: a filter on the payload, applied first."""
    rows = df if where is None else df.where(where)
    return rows.select(F.col(id_column).alias("rowid"), METRICS[metric](F.col(vector), literal(query)).alias("distance")).orderBy("distance", "rowid").limit(k)


def range_search(df: DataFrame, id_column: str, vector: str, query: list[float], threshold: float, metric: str = "l2") -> DataFrame:
    """(rowid, distance) of all within the threshold, itself included."""
    return df.select(F.col(id_column).alias("rowid"), METRICS[metric](F.col(vector), literal(query)).alias("distance")).where(F.col("distance") <= threshold)


#: Rows of a meeting of targets and queries, and queries that it takes at once: what bounds a task's memory.
MEET_TARGETS, MEET_QUERIES, AT_ONCE = 8192, 4096, 128


def _pair_distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """The distances of rows i of x and j of y, summed along the vector as METRICS does."""

    def along(f) -> np.ndarray:
        out = np.zeros(len(i))
        for c in range(x.shape[1]):
            out += f(x[i, c], y[j, c])
        return out

    if metric in ("l2", "l2sq"):
        square = along(lambda a, b: (a - b) * (a - b))
        return np.sqrt(square) if metric == "l2" else square
    product = along(lambda a, b: a * b)
    if metric == "inner_product":
        return -product
    size = np.sqrt(along(lambda a, b: a * a)) * np.sqrt(along(lambda a, b: b * b))
    return 1 - np.divide(product, size, out=np.zeros(len(i)), where=size != 0)


def _likely(x: np.ndarray, y: np.ndarray, k: int, metric: str, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y) that hold each y's k nearest: a matrix product, with a margin beyond its error and the slack."""
    if len(x) <= k or not (np.isfinite(x).all() and np.isfinite(y).all()):
        return np.tile(np.arange(len(x)), len(y)), np.repeat(np.arange(len(y)), len(x))
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    gaps = -(y @ x.T)
    if metric in ("l2", "l2sq"):
        gaps = yy[:, None] + 2 * gaps + xx[None]
        error = 1e-10 * (np.sqrt(xx.max()) + np.sqrt(yy)) ** 2
    elif metric == "inner_product":
        error = 1e-10 * np.sqrt(xx.max() * yy)
    else:
        size = np.sqrt(yy)[:, None] * np.sqrt(xx)[None]
        gaps = 1 + np.divide(gaps, size, out=np.zeros_like(gaps), where=size != 0)
        error = np.full(len(y), 1e-9)
    last = np.partition(gaps, k - 1, 1)[:, k - 1] + 2 * error
    last = (np.sqrt(np.maximum(last, 0)) + slack) ** 2 + error if metric == "l2" else last + slack
    #: What isn't finite after all, by overflow, stays.
    j, i = np.nonzero(~(gaps > last[:, None]))
    return i, j


def search_join(targets: DataFrame, target_id: str, target_vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, metric: str = "l2", blocks: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_rowid, rowid, distance): each query's k nearest targets, ties to the smaller id; distances of null last.

    Blocks of targets meet blocks of queries, all of them, but a meeting's rows are bounded. A matrix product rules most pairs
    out, with a margin for its error; the distances of the others are summed exactly, and the meetings' winners ranked together.
    blocks: of targets, instead of as many as the rows need. digits: places by which distances are compared."""
    if metric not in METRICS:
        raise ValueError(f"no metric named {metric}")
    whole = lambda v: F.when(~F.exists(v, lambda x: x.isNull()), v.cast("array<double>"))
    n_targets, n_queries = targets.count(), queries.count()
    t_blocks = blocks or max(1, -(-n_targets // MEET_TARGETS), min(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_targets // 1024))
    q_blocks = max(1, -(-n_queries // MEET_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = targets.select(F.col(target_id).alias("rowid"), whole(F.col(target_vector)).alias("v"), F.pmod(F.xxhash64(target_id), F.lit(t_blocks)).cast("int").alias("b")).withColumn("c", every(q_blocks))
    q = queries.select(F.col(query_id).alias("query_rowid"), whole(F.col(query_vector)).alias("v"), F.pmod(F.xxhash64(query_id), F.lit(q_blocks)).cast("int").alias("c")).withColumn("b", every(t_blocks))
    names = ["query_rowid", "rowid", "distance", "place"]

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=names)]
        ids, asked = left["rowid"].to_numpy(), right["query_rowid"].to_numpy()
        rank = np.unique(ids, return_inverse=True)[1] if len(ids) else np.zeros(0, int)
        dims = lambda rows: np.array([-1 if v is None else len(v) for v in rows["v"]], int)
        t_dims, q_dims = dims(left), dims(right)
        for dim in np.unique(q_dims).tolist():
            own = np.flatnonzero(t_dims == dim) if dim >= 0 else np.zeros(0, int)
            other = np.setdiff1d(np.arange(len(ids)), own)
            other = other[np.argsort(rank[other], kind="stable")][: max(0, k - len(own))]
            x = np.array(left["v"].iloc[own].tolist(), float).reshape(len(own), max(dim, 0))
            mine = np.flatnonzero(q_dims == dim)
            for at in range(0, len(mine), AT_ONCE):
                some = mine[at : at + AT_ONCE]
                if len(own):
                    y = np.array(right["v"].iloc[some].tolist(), float).reshape(len(some), dim)
                    i, j = _likely(x, y, k, metric, 0.0 if digits is None else 1.01 * 10.0**-digits)
                    d = _pair_distances(x, y, i, j, metric)
                    place = d
                    if digits is not None:
                        scaled = d * 10.0**digits
                        place = (np.floor(scaled) + (scaled - np.floor(scaled) >= 0.5)) / 10.0**digits
                    order = np.lexsort((rank[own[i]], place, j))
                    first = np.searchsorted(j[order], np.arange(len(some)))
                    order = order[np.arange(len(order)) - first[j[order]] < k]
                    out.append(pd.DataFrame({"query_rowid": asked[some[j[order]]], "rowid": ids[own[i[order]]], "distance": d[order], "place": place[order]}))
                if len(other):
                    out.append(pd.DataFrame({"query_rowid": np.repeat(asked[some], len(other)), "rowid": np.tile(ids[other], len(some)), "distance": None, "place": None}))
        return pd.concat([o for o in out if len(o)] or out)

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    near = t.groupBy("b", "c").cogroup(q.groupBy("b", "c")).applyInPandas(met, f"query_rowid {kind(q, 'query_rowid')}, rowid {kind(t, 'rowid')}, distance double, place double")
    last = Window.partitionBy("query_rowid").orderBy(F.asc_nulls_last("place"), "rowid")
    return near.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= k).select("query_rowid", "rowid", "distance")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def parse(query: str) -> tuple:
    """A full-text query as a tree: ("term", words, prefix), ("not", x), ("and", x, y), ("or", x, y).

    Terms, "phrases", prefix* (also of a phrase's last word), AND (also implied), OR, NOT or -, parentheses."""
    parts = re.findall(r'"[^"]*"\*?|\(|\)|-(?=\S)|[^\s()"]+', query)

    def either(i: int) -> tuple[tuple, int]:
        c, i = both(i)
        while i < len(parts) and parts[i].upper() == "OR":
            d, i = both(i + 1)
            c = ("or", c, d)
        return c, i

    def both(i: int) -> tuple[tuple, int]:
        c, i = one(i)
        while i < len(parts) and parts[i] != ")" and parts[i].upper() != "OR":
            d, i = one(i + 1 if parts[i].upper() == "AND" else i)
            c = ("and", c, d)
        return c, i

    def one(i: int) -> tuple[tuple, int]:
        if i >= len(parts):
            raise ValueError(f"the full-text query ends too early: {query!r}")
        if parts[i].upper() == "NOT" or parts[i] == "-":
            c, i = one(i + 1)
            return ("not", c), i
        if parts[i] == "(":
            c, i = either(i + 1)
            return c, i + 1
        return ("term", tuple(re.findall(r"[a-z0-9_]+", parts[i].lower())), parts[i].endswith("*")), i + 1

    return either(0)[0]


def wanted(tree: tuple) -> list[tuple]:
    """The terms that a query asks for; those under NOT are left out."""
    kind, *rest = tree
    return [tree] if kind == "term" else [] if kind == "not" else sorted({t for x in rest for t in wanted(x)})


def frequency(held: Column, term: tuple) -> Column:
    """How often a word, prefix or phrase stands in a list of tokens."""
    _, words, prefix = term
    if not words:
        return F.lit(0)
    is_last = (lambda x: F.startswith(x, F.lit(words[-1]))) if prefix else (lambda x: x == words[-1])
    if len(words) == 1:
        return F.size(F.filter(held, is_last))

    def places(held: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(held) - len(words))

        def found(i: Column) -> Column:
            same = is_last(F.get(held, i + len(words) - 1))
            for k, w in enumerate(words[:-1]):
                same = (F.get(held, i + k) == w) & same
            return same

        return F.when(F.size(held) >= len(words), F.size(F.filter(at, found))).otherwise(0)

    #: The list is bound by a lambda of its own. Inside the other one, its expression would be worked out for each token.
    return F.get(F.transform(F.array(held), places), F.lit(0))


def _holds(has: Callable[[tuple], Column], tree: tuple) -> Column:
    """The tree as a predicate; has: whether a term is there."""
    kind, *rest = tree
    if kind == "term":
        return has(tree)
    if kind == "not":
        return ~_holds(has, rest[0])
    a, b = (_holds(has, x) for x in rest)
    return a & b if kind == "and" else a | b


def matches(text: Column, query: str) -> Column:
    """A full-text query (see parse) as a predicate. A term is one search of the text: its words with other characters between."""
    lowered = F.lower(text)

    def has(term: tuple) -> Column:
        _, words, prefix = term
        pattern = "(?<![a-z0-9_])" + "[^a-z0-9_]++".join(words) + ("" if prefix else "(?![a-z0-9_])")
        return lowered.rlike(pattern) if words else F.lit(False)

    return _holds(has, parse(query))


def bm25(docs: DataFrame, id_column: str, text: str, query: str) -> DataFrame:
    """(rowid, score) of the documents that match the query (see parse): the sum over its words, prefixes and phrases, of which
    none is under NOT. A query of plain words alone asks for any of them. Only counts are shuffled, not texts; corpus figures
    are one row."""
    tree = parse(query)
    terms = wanted(tree)
    if re.fullmatch(r"[\w\s]+", query) and not re.search(r"\b(AND|OR|NOT)\b", query, re.IGNORECASE):
        tree = None
    held = docs.select(F.col(id_column).alias("rowid"), tokens(F.col(text)).alias("__t"))
    counted = held.select("rowid", F.size("__t").alias("__n"), *(frequency(F.col("__t"), t).alias(f"__tf_{i}") for i, t in enumerate(terms)), (F.lit(True) if tree is None else _holds(lambda x: frequency(F.col("__t"), x) > 0, tree)).alias("__hit"))
    figures = counted.agg(F.count("*").alias("__docs"), F.avg("__n").alias("__avg"), *(F.sum((F.col(f"__tf_{i}") > 0).cast("int")).alias(f"__df_{i}") for i in range(len(terms))))
    score, any_term = F.lit(0.0), F.lit(False)
    for i in range(len(terms)):
        tf, df = F.col(f"__tf_{i}"), F.col(f"__df_{i}")
        idf = F.log(1 + (F.col("__docs") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__n") / F.col("__avg")))).otherwise(0.0)
        any_term = any_term | (tf > 0)
    return counted.where(F.col("__hit") & any_term).join(F.broadcast(figures)).select("rowid", score.alias("score"))


def rrf(*ranks: Column) -> Column:
    """Reciprocal rank fusion; a missing rank adds nothing."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.when(r.isNull(), 0.0).otherwise(1 / (RRF_K + r))
    return out


def hybrid_search(vectors: DataFrame, vector_id: str, vector: str, docs: DataFrame, doc_id: str, text: str, query: list[float], words: str, k: int) -> DataFrame:
    """(rowid, distance, bm25, rrf_score): the rankings of all rows by vector and of all matches by BM25, fused by rank.

    Both rankings are whole, numbered by sorted ranges, so that no task holds all rows."""
    near = vectors.select(F.col(vector_id).alias("rowid"), METRICS["cosine"](F.col(vector), literal(query)).alias("distance"))
    near = next_values(near, ["distance", "rowid"], "__v")
    good = next_values(bm25(docs, doc_id, text, words), [F.desc("score"), "rowid"], "__b")
    both = near.join(good, "rowid", "full")
    return both.select("rowid", "distance", F.col("score").alias("bm25"), rrf(F.col("__v"), F.col("__b")).alias("rrf_score")).orderBy(F.desc("rrf_score"), "rowid").limit(k)


def vec_average(df: DataFrame, group: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """VEC_AVG: the mean vector of each group; null vectors are left out."""
    at = df.select(*group, F.posexplode(vector).alias("__i", "__x")).groupBy(*group, "__i").agg(F.avg("__x").alias("__x"))
    return at.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__x"))), lambda s: s["__x"]).alias(name))


def box_intersects(lo: list[str], hi: list[str], box_lo: list[float], box_hi: list[float]) -> Column:
    """Whether the box of columns lo..hi meets the given one, in every dimension."""
    out = F.lit(True)
    for a, b, x, y in zip(lo, hi, box_lo, box_hi, strict=True):
        out = out & (F.col(a) <= y) & (F.col(b) >= x)
    return out


def queries_of(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """(query_idx, query): a batch of query vectors, numbered from 0."""
    return spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(rows)], "query_idx int, query array<double>")


def search_batch(df: DataFrame, id_column: str, vector: str, queries: list[list[float]], k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """(query_idx, rowid, distance): each query's k nearest of the rows that the payload filter keeps."""
    rows = df if where is None else df.where(where)
    return search_join(rows, id_column, vector, queries_of(df.sparkSession, queries), "query_idx", "query", k, metric).withColumnRenamed("query_rowid", "query_idx")


def search_join_filtered(targets: DataFrame, target_id: str, target_vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, where: Column, metric: str = "l2") -> DataFrame:
    """search_join over the targets that the payload filter keeps."""
    return search_join(targets.where(where), target_id, target_vector, queries, query_id, query_vector, k, metric)


def range_search_batch(df: DataFrame, id_column: str, vector: str, queries: list[list[float]], threshold: float, metric: str = "l2") -> DataFrame:
    """(query_idx, rowid, distance) of all rows within the threshold of each query. The table is read once: the queries, a
    literal of the plan, are unfolded beside each row."""
    asked = F.array(*(F.struct(F.lit(i).alias("query_idx"), literal(q).alias("query")) for i, q in enumerate(queries)))
    rows = df.select(F.col(id_column).alias("rowid"), F.col(vector).alias("__v"), F.explode(asked).alias("__q"))
    return rows.select(F.col("__q.query_idx").alias("query_idx"), "rowid", METRICS[metric](F.col("__v"), F.col("__q.query")).alias("distance")).where(F.col("distance") <= threshold)


def hybrid_search_batch(vectors: DataFrame, vector_id: str, vector: str, docs: DataFrame, doc_id: str, text: str, queries: list[tuple[list[float], str]], k: int) -> DataFrame:
    """(query_idx, rowid, distance, bm25, rrf_score): hybrid_search of each pair of a vector and words."""
    out = None
    for i, (q, words) in enumerate(queries):
        one = hybrid_search(vectors, vector_id, vector, docs, doc_id, text, q, words, k).select(F.lit(i).alias("query_idx"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def vec_sum(df: DataFrame, group: list[str], vector: str, name: str = "total") -> DataFrame:
    """VEC_SUM: the sum of each group's vectors; null vectors are left out."""
    at = df.select(*group, F.posexplode(vector).alias("__i", "__x")).groupBy(*group, "__i").agg(F.sum("__x").alias("__x"))
    return at.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__x"))), lambda s: s["__x"]).alias(name))


def box_join(left: DataFrame, right: DataFrame, lo: str, hi: str, other_lo: str, other_hi: str, width: float) -> DataFrame:
    """Pairs of rows whose intervals meet. Intervals go to the grid cells they cover, so the join is an equi-join; a pair is
    kept in the first cell that both cover. Column names of the sides must differ."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    pairs = left.withColumn("__cell", cells(lo, hi)).join(right.withColumn("__cell", cells(other_lo, other_hi)), "__cell")
    first = F.floor(F.greatest(lo, other_lo) / width)
    return pairs.where((F.col(lo) <= F.col(other_hi)) & (F.col(hi) >= F.col(other_lo)) & (F.col("__cell") == first)).drop("__cell")
