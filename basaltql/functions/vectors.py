"""Vector functions over arrays of numbers, or their JSON text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basaltql.functions.scalar import named
from basaltql.operators.retrieval import cosine_similarity, dot, l2sq, norm


@named("VEC", "VEC_F32")
def vec(x: Column) -> Column:
    """An array, or a JSON text of one, as array<float>; null for other texts."""
    return F.from_json(x.cast("string"), "array<float>")


@named("VEC_DIM")
def vec_dim(x: Column) -> Column:
    return F.when(x.isNotNull(), F.size(x))


@named("VEC_LENGTH")
def vec_length(x: Column) -> Column:
    """Bytes: four for each component."""
    return vec_dim(x) * 4


@named("VEC_SLICE")
def vec_slice(x: Column, start: Column, end: Column) -> Column:
    """Components start (from 0) up to end, not included; both are clamped."""
    a = F.least(F.greatest(start, F.lit(0)), F.size(x))
    b = F.least(F.greatest(end, a), F.size(x))
    return F.slice(x, a + 1, b - a)


@named("VEC_TO_JSON")
def vec_to_json(x: Column) -> Column:
    return F.to_json(x)


named("VEC_L2SQ")(l2sq)
named("VEC_L2", "VEC_DISTANCE_L2")(lambda a, b: F.sqrt(l2sq(a, b)))
named("VEC_IP", "VEC_DOT")(dot)
named("VEC_COSINE_SIM")(cosine_similarity)
named("VEC_COSINE", "VEC_DISTANCE_COSINE")(lambda a, b: 1 - cosine_similarity(a, b))
named("VEC_NORM")(norm)


@named("VEC_NORMALIZE")
def vec_normalize(x: Column) -> Column:
    """Length 1; the zero vector stays."""
    return F.when(norm(x) == 0, F.transform(x, lambda v: v.cast("float"))).otherwise(F.transform(x, lambda v: F.try_divide(v.cast("double"), norm(x)).cast("float")))


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions"))).otherwise(value)


@named("VEC_ADD")
def vec_add(a: Column, b: Column) -> Column:
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: (x + y).cast("float")))


@named("VEC_SUB")
def vec_sub(a: Column, b: Column) -> Column:
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: (x - y).cast("float")))


@named("RRF")
def rrf(*ranks: Column) -> Column:
    """Reciprocal rank fusion; a null rank adds nothing."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(1.0 / (60 + r), F.lit(0.0))
    return out
