"""Matrices as long rows (i, j, v), absent cells being zeros: sums, products, selections.  Sizes come from the data, nothing is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(df: DataFrame, row: str, vector: Column) -> DataFrame:
    """The cells of a column of arrays, columns counted from 0; null rows, null arrays and null components give none."""
    return df.select(F.col(row).alias("i"), F.posexplode(vector).alias("j", "v")).where("i IS NOT NULL AND v IS NOT NULL").select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.sum("v").alias("sum"))


def column_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.sum("v").alias("sum"))


def add(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    """a + scale * b; one aggregate, no join."""
    return a.select("i", "j", "v").unionByName(b.select("i", "j", (F.col("v") * scale).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def select_columns(m: DataFrame, wanted: list[int]) -> DataFrame:
    return m.where(F.col("j").isin(wanted))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """a times b: cells meet on the inner index and are summed by place, partly before the shuffle.

    Meant for sparse sides or few cells an inner index: the work is the number of products, as in any multiplication by the definition.
    """
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def gram(df: DataFrame, vector: Column, width: int) -> DataFrame:
    """The products of all pairs of columns of an array column, summed over rows: one pass, ``width`` squared sums a task."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), (F.get("_x", i) * F.get("_x", j)).alias("v")))))
    return df.select(vector.cast("array<double>").alias("_x")).select(F.explode(pairs).alias("p")).select("p.*").where("v IS NOT NULL").groupBy("i", "j").agg(F.sum("v").alias("v"))
