"""Distances between numeric arrays, as expressions; smaller is nearer for all of them."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "dot")


def _vector(v: Column | Sequence[float]) -> Column:
    return v.cast("array<double>") if isinstance(v, Column) else F.array(*(F.lit(float(x)) for x in v))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda total, x: total + x)


#: Up to this length, sums over a given vector are written out, which stays in generated code; beyond it they loop.
WRITTEN_OUT = 256


def _checked(a: Column, size: Column, total: Column) -> Column:
    return F.when(F.size(a) == size, total).otherwise(F.raise_error("vectors of different lengths").cast("double"))


def _over(a: Column, b: Column | Sequence[float], term) -> Column:
    """The sum of term(x, y) over two vectors, in order; fails on lengths that differ, as that means nothing."""
    if isinstance(b, Column):
        return _checked(a, F.size(b), _sum(F.zip_with(_vector(a), _vector(b), term)))
    values = [float(y) for y in b]
    if len(values) > WRITTEN_OUT:
        return _checked(a, F.lit(len(values)), _sum(F.zip_with(_vector(a), _vector(values), term)))
    total = F.lit(0.0)
    for k, y in enumerate(values):
        total = total + term(F.get(a, F.lit(k)).cast("double"), F.lit(y))
    return _checked(a, F.lit(len(values)), total)


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    return _over(a, b, lambda x, y: x * y)


def l2_squared(a: Column, b: Column | Sequence[float]) -> Column:
    return _over(a, b, lambda x, y: (x - y) * (x - y))


def norm(a: Column | Sequence[float]) -> Column:
    if not isinstance(a, Column):
        return F.lit(sqrt(sum(float(x) ** 2 for x in a)))
    return F.sqrt(_sum(F.transform(_vector(a), lambda x: x * x)))


def cosine_distance(a: Column, b: Column | Sequence[float]) -> Column:
    """1 - cosine similarity; the similarity with a zero vector is 0."""
    lengths = norm(a) * norm(b)
    return 1 - F.when(lengths == 0, 0.0).otherwise(dot(a, b) / lengths)


def distance(a: Column, b: Column | Sequence[float], metric: str = "cosine") -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    d = {"cosine": cosine_distance, "l2": l2_squared, "dot": lambda x, y: -dot(x, y)}[metric](a, b)
    return F.when(a.isNotNull(), d)
