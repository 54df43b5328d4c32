"""Synthetic tables, made row by row from hashes of the row's number: the same at any parallelism."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, i: int = 0) -> Column:
    """In (0, 1), by row id, seed and stream i."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("id")), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


def gaussian(seed: int, i: int = 0) -> Column:
    """Standard normal, from two uniforms."""
    return F.sqrt(-2 * F.ln(uniform(seed, 2 * i))) * F.cos(2 * math.pi * uniform(seed, 2 * i + 1))


def checkerboard(spark: SparkSession, n: int, squares: int = 5, low: float = 0.0, high: float = 10.0, seed: int = 1) -> DataFrame:
    """x, y and the parity of their square."""
    step = (high - low) / squares
    df = spark.range(n).withColumn("x", uniform(seed, 0) * (high - low) + low).withColumn("y", uniform(seed, 1) * (high - low) + low)
    return df.withColumn("label", F.when((F.floor((F.col("x") - low) / step) + F.floor((F.col("y") - low) / step)) % 2 == 0, "First").otherwise("Second"))


def circles(spark: SparkSession, n: int, radius: float = 2.0, inner: float = 0.5, seed: int = 1) -> DataFrame:
    """Points in a disc; the label tells whether they lie within ``inner`` of the radius."""
    df = spark.range(n).withColumn("r", radius * F.sqrt(uniform(seed, 0))).withColumn("a", 2 * math.pi * uniform(seed, 1))
    return df.select("id", (F.col("r") * F.cos("a")).alias("x"), (F.col("r") * F.sin("a")).alias("y"), F.when(F.col("r") <= radius * inner, "First").otherwise("Second").alias("label"))


def two_gaussians(spark: SparkSession, n: int, first=((0.0, 0.0), 1.0), second=((2.0, 2.0), 1.0), seed: int = 1) -> DataFrame:
    one = F.col("id") % 2 == 0
    pick = lambda a, b: F.when(one, a).otherwise(b)
    return spark.range(n).select("id", *[(pick(first[0][j], second[0][j]) + pick(first[1], second[1]) * gaussian(seed, j)).alias("xy"[j]) for j in range(2)], pick("First", "Second").alias("label"))


def crescents(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """Two interlocking half moons, with Gaussian noise."""
    one, a = F.col("id") % 2 == 0, math.pi * uniform(seed, 0)
    x = F.when(one, F.cos(a)).otherwise(1 - F.cos(a))
    y = F.when(one, F.sin(a)).otherwise(0.5 - F.sin(a))
    return spark.range(n).select("id", (x + noise * gaussian(seed, 2)).alias("x"), (y + noise * gaussian(seed, 3)).alias("y"), F.when(one, "First").otherwise("Second").alias("label"))


def gaussian_clusters(spark: SparkSession, n: int, means: list[list[float]], weights: list[float], std: float = 1.0, seed: int = 1) -> DataFrame:
    """A mixture of spherical Gaussians; ``cluster`` is the component."""
    u, edge, pick = uniform(seed, 99), 0.0, F.lit(len(means) - 1)
    for i in range(len(means) - 1, -1, -1):
        edge = sum(weights[:i]) / sum(weights)
        pick = F.when(u >= edge, pick) if i == len(means) - 1 else pick.when(u >= edge, i)
    df = spark.range(n).withColumn("cluster", pick)
    centre = lambda j: F.element_at(F.array(*[F.lit(float(m[j])) for m in means]), F.col("cluster") + 1)
    return df.select("id", "cluster", *[(centre(j) + std * gaussian(seed, j)).alias(f"x{j}") for j in range(len(means[0]))])


def linear_regression(spark: SparkSession, n: int, weights: list[float], bias: float = 0.0, noise: float = 1.0, seed: int = 1) -> DataFrame:
    """y = w x + b + noise."""
    xs = [gaussian(seed, j) for j in range(len(weights))]
    df = spark.range(n).select("id", *[x.alias(f"x{j}") for j, x in enumerate(xs)])
    y = sum((F.col(f"x{j}") * w for j, w in enumerate(weights)), F.lit(bias))
    return df.withColumn("y", y + noise * gaussian(seed, 1000))


def nonlinear_regression(spark: SparkSession, n: int, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0), bias: float = 0.0, noise: float = 1.0, seed: int = 1) -> DataFrame:
    """y = w0 x0 + w1 x1 + w2 x0 x1 + w3 x1^3 + b + noise."""
    df = spark.range(n).select("id", gaussian(seed, 0).alias("x0"), gaussian(seed, 1).alias("x1"))
    a, b = F.col("x0"), F.col("x1")
    return df.withColumn("y", weights[0] * a + weights[1] * b + weights[2] * a * b + weights[3] * b * b * b + bias + noise * gaussian(seed, 1000))


def anomalies(spark: SparkSession, n: int, share: float = 0.3, dims: int = 5, far: float = 10.0, seed: int = 1) -> DataFrame:
    """Expected rows around 0, anomalous ones around ``far``."""
    bad = uniform(seed, 99) < share
    return spark.range(n).select("id", *[(F.when(bad, far).otherwise(0.0) + gaussian(seed, j)).alias(f"x{j}") for j in range(dims)], F.when(bad, "ANOMALOUS").otherwise("EXPECTED").alias("event"))


def multilabels(spark: SparkSession, n: int, labels: list[str], dims: int = 4, seed: int = 1) -> DataFrame:
    """A set of labels, each shifting a feature."""
    has = [uniform(seed, 100 + i) < 0.5 for i in range(len(labels))]
    df = spark.range(n).withColumn("labels", F.array_compact(F.array(*[F.when(h, l) for h, l in zip(has, labels)])))
    return df.select("id", "labels", *[(F.when(F.array_contains("labels", labels[j % len(labels)]), 2.0).otherwise(-2.0) + gaussian(seed, j)).alias(f"x{j}") for j in range(dims)])


def sequences(spark: SparkSession, n: int, length: int = 5, seed: int = 1) -> DataFrame:
    """Sequences of (pos, feature, label): a label follows from the feature and the label before."""
    df = spark.range(n).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    word = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("pos")), F.lit(4))
    return df.select(F.col("id").alias("seq"), "pos", F.concat(F.lit("w"), word.cast("string")).alias("feature"), F.when(word < 2, "O").otherwise("X").alias("label"))
