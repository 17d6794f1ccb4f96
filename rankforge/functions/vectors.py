"""Vector functions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), size))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l2_normalize(a: Column) -> Column:
    """A zero vector stays as it is."""
    return F.when(norm(a) == 0, a).otherwise(F.transform(a, lambda x: F.try_divide(x, norm(a))))


def hybrid_distance_scalar(a: Column, b: Column) -> Column:
    """Cosine distance plus the Euclidean distance over itself (1 unless it is 0)."""
    return (1 - cosine(a, b)) + F.when(euclidean(a, b) > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def wasserstein_1d(a: Column, b: Column) -> Column:
    """First Wasserstein distance between the values of two sum-normalised vectors of one length."""
    scaled = lambda v: F.array_sort(F.transform(v, lambda x: F.try_divide(x, _sum(v))))
    return _sum(F.zip_with(scaled(a), scaled(b), lambda x, y: F.abs(x - y))) / F.size(a)


def optimal_transport_1d(a: Column, b: Column) -> Column:
    """Earth mover's distance with cost |i - j| between the absolute values, each made a distribution."""
    mass = lambda v: F.transform(v, lambda x: F.try_divide(F.abs(x), _sum(F.transform(v, F.abs))))
    gaps = F.zip_with(mass(a), mass(b), lambda x, y: x - y)
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("cost"))
    return F.aggregate(gaps, start, lambda s, g: F.struct((s["at"] + g).alias("at"), (s["cost"] + F.abs(s["at"] + g)).alias("cost")), lambda s: s["cost"])
