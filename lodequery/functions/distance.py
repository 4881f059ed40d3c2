"""Distances between vectors as Column expressions; smaller is nearer.

Arithmetic is in double. A zero vector is at cosine distance 1 from everything.
With a query vector that is known when the plan is made, dot products and sums
are unrolled into plain arithmetic, which stays inside whole-stage codegen; for
vectors in columns, or of many dimensions, higher-order functions do it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodequery.errors import DimensionMismatch, InvalidConfig, InvalidVector

COSINE, EUCLIDEAN, DOT, MANHATTAN = "cosine", "euclidean", "dot", "manhattan"
_ALIASES = {
    "cosine": COSINE,
    "cos": COSINE,
    "euclidean": EUCLIDEAN,
    "l2": EUCLIDEAN,
    "dot": DOT,
    "dot_product": DOT,
    "dotproduct": DOT,
    "inner": DOT,
    "manhattan": MANHATTAN,
    "l1": MANHATTAN,
}
UNROLL = 256


def parse_distance(name: str) -> str:
    """The distance with this name or alias."""
    try:
        return _ALIASES[name.lower()]
    except KeyError:
        raise InvalidConfig(f"unknown distance {name!r}") from None


def check_query(query: Sequence[float], dimensions: int | None = None) -> list[float]:
    """The query vector as floats, checked for its length and for values that are not finite."""
    if dimensions is not None and len(query) != dimensions:
        raise DimensionMismatch(dimensions, len(query))
    for i, x in enumerate(query):
        if not math.isfinite(x):
            raise InvalidVector(f"value {i} of the vector is not finite")
    return [float(x) for x in query]


def _total(terms: list[Column]) -> Column:
    """Sum of the terms, as a balanced tree so that deep plans are avoided."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
    return terms[0]


def fold(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _double(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)))


def norm(a: Column) -> Column:
    return F.sqrt(fold(F.transform(a, lambda x: _double(x) * _double(x))))


def _cosine(product: Column, norms: Column) -> Column:
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - product / norms)


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance of two vector columns."""
    metric = parse_distance(metric)
    if metric == COSINE:
        return _cosine(dot(a, b), norm(a) * norm(b))
    if metric == DOT:
        return -dot(a, b)
    if metric == MANHATTAN:
        return fold(F.zip_with(a, b, lambda x, y: F.abs(_double(x) - _double(y))))
    return F.sqrt(fold(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y)))))


def distance_to(metric: str, vector: Column, query: Sequence[float]) -> Column:
    """Distance of a vector column to a given query vector."""
    metric, query = parse_distance(metric), check_query(query)
    if not query or len(query) > UNROLL:
        return distance(metric, vector, F.array(*[F.lit(x) for x in query]))
    parts = [_double(F.get(vector, F.lit(i))) for i in range(len(query))]
    if metric in (COSINE, DOT):
        product = _total([p * q for p, q in zip(parts, query, strict=True)])
        if metric == DOT:
            return -product
        size = math.sqrt(sum(q * q for q in query))
        return _cosine(product, F.sqrt(_total([p * p for p in parts])) * size)
    if metric == MANHATTAN:
        return _total([F.abs(p - q) for p, q in zip(parts, query, strict=True)])
    return F.sqrt(_total([(p - q) * (p - q) for p, q in zip(parts, query, strict=True)]))


def normalised(v: Column) -> Column:
    """The vector over its norm; as it is where the norm is at most 1e-10."""
    size = norm(v)
    return F.when(size > 1e-10, F.transform(v, lambda x: _double(x) / size)).otherwise(F.transform(v, _double))


def matryoshka(v: Column, dimensions: int) -> Column:
    """The first ``dimensions`` values, normalised."""
    return normalised(F.slice(v, 1, dimensions))


def all_finite(v: Column) -> Column:
    """True for vectors without NaN and infinities."""
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def first_bad_index(v: Column) -> Column:
    """0-based index of the first value that is not finite, null if there is none."""
    bad = F.transform(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    at = F.array_position(bad, True)
    return F.when(at > 0, at - 1)
