"""Distances, kernels and vector algebra over ARRAY<DOUBLE> columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def one_norm(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: F.abs(x)))


def two_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where the inner product is 0."""
    d = dot(a, b)
    return F.when(d == 0.0, 0.0).otherwise(d / (two_norm(a) * two_norm(b)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


DISTANCES = {"L1": l1, "L2": l2, "COSINE": cosine_distance}


def linear_kernel(a: Column, b: Column) -> Column:
    return dot(a, b)


def polynomial_kernel(a: Column, b: Column, gamma: float = 1.0, intercept: float = 0.0, degree: float = 2.0) -> Column:
    return F.pow(gamma * dot(a, b) + intercept, F.lit(float(degree)))


def rbf_kernel(a: Column, b: Column, gamma: float = 1.0) -> Column:
    return F.exp(-gamma * l2_squared(a, b))


def sigmoid_kernel(a: Column, b: Column, gamma: float = 1.0, intercept: float = 0.0) -> Column:
    return F.tanh(gamma * dot(a, b) + intercept)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * k)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def variance(a: Column) -> Column:
    """Sample variance."""
    m = mean(a)
    return F.when(F.size(a) > 1, _sum(F.transform(a, lambda x: (x - m) * (x - m))) / (F.size(a) - 1)).otherwise(0.0)


def arg_max(a: Column) -> Column:
    """Place of the greatest value from 0; the first of several."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def arg_min(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)).cast("int") - 1


def to_distribution(a: Column) -> Column:
    total = _sum(a)
    return F.transform(a, lambda x: x / total)


def standardise(a: Column) -> Column:
    m, s = mean(a), F.sqrt(variance(a))
    return F.transform(a, lambda x: (x - m) / s)


def sparse_dot(a: Column, b: Column) -> Column:
    """Inner product of two MAP<STRING,DOUBLE> columns."""
    return _sum(F.transform(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda k: a[k] * b[k]))


def sparse_l1(a: Column, b: Column) -> Column:
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return _sum(F.transform(keys, lambda k: F.abs(F.coalesce(F.try_element_at(a, k), F.lit(0.0)) - F.coalesce(F.try_element_at(b, k), F.lit(0.0)))))


def sparse_l2(a: Column, b: Column) -> Column:
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    d = F.transform(keys, lambda k: F.coalesce(F.try_element_at(a, k), F.lit(0.0)) - F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
    return F.sqrt(_sum(F.transform(d, lambda x: x * x)))


def difference(a: Column, b: Column) -> Column:
    """Sorted values of a that b lacks."""
    return F.array_sort(F.array_except(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b|; NaN when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(float("nan")))
