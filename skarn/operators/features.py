"""Rows of named features in long form (id, name, value): domains, selection, densifying, merging.

The long form is the shuffle-friendly one: all statistics are partial
aggregates by name, selections are semi-joins with the (small) set of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.sampling import position


def melt(df: DataFrame, id_cols: list[str], value_cols: list[str], drop_zeros: bool = False) -> DataFrame:
    """Wide numeric columns as (ids..., name, value); one pass, no shuffle.  Nulls are absent features."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in value_cols])
    out = df.select(*id_cols, F.explode(pairs).alias("f")).select(*id_cols, "f.name", "f.value").where("value IS NOT NULL")
    return out.where("value <> 0") if drop_zeros else out


def spread(features: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """Long features as one row an id with a column for each name; absent features are 0."""
    return features.groupBy(id_col).agg(*[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in names])


def feature_domain(features: DataFrame, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """Per feature, over non-zero values: n, n_distinct, min, max, mean, sample variance, and a dense id in name order."""
    stats = features.where("value <> 0").groupBy(*by).agg(
        F.count("*").alias("n"),
        F.countDistinct("value").alias("n_distinct"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"),
    )
    # ids over the domain's names, by ranges of them
    return position(stats, [F.col(c) for c in by], "fid").withColumn("fid", F.col("fid").cast("int"))


def is_categorical(domain: DataFrame, most: int = 50) -> DataFrame:
    """The domain with ``kind``: CATEGORICAL up to ``most`` distinct values, REAL beyond."""
    return domain.withColumn("kind", F.when(F.col("n_distinct") <= most, "CATEGORICAL").otherwise("REAL"))


def histogram(df: DataFrame, col: str, weight: Column | None = None) -> DataFrame:
    """value -> count (and weight)."""
    aggs = [F.count("*").alias("n")] + ([F.sum(weight).alias("weight")] if weight is not None else [])
    return df.groupBy(F.col(col).alias("value")).agg(*aggs)


def minimum_cardinality(features: DataFrame, least: int, id_col: str = "id") -> DataFrame:
    """Features seen in ``least`` rows or more; rows left without any are gone with them."""
    kept = features.groupBy("name").agg(F.countDistinct(id_col).alias("n")).where(F.col("n") >= least).select("name")
    return features.join(kept, "name", "left_semi")


def minimum_cardinality_sequences(features: DataFrame, least: int, seq_id: str = "seq", pos: str = "pos") -> DataFrame:
    """The same over sequences, rows being (seq, pos, name, value): a feature counts once an element, and a sequence with an element left without any feature goes as a whole."""
    kept = features.groupBy("name").agg(F.countDistinct(seq_id, pos).alias("n")).where(F.col("n") >= least).select("name", F.lit(True).alias("_kept"))
    marked = features.join(kept, "name", "left")
    bare = marked.groupBy(seq_id, pos).agg(F.max("_kept").alias("k")).where("k IS NULL").select(seq_id).distinct()
    return marked.where("_kept").drop("_kept").join(bare, seq_id, "left_anti")


def removed_features(features: DataFrame, least: int, id_col: str = "id") -> DataFrame:
    """The names that minimum_cardinality takes out, with their counts."""
    return features.groupBy("name").agg(F.countDistinct(id_col).alias("n")).where(F.col("n") < least)


def select_features(features: DataFrame, ranked: DataFrame, top: int | None = None) -> DataFrame:
    """Features whose name is among the ``top`` (or all) of ``ranked`` (name, score), best first, ties by name."""
    names = ranked.orderBy(F.desc("score"), "name").limit(top) if top else ranked
    return features.join(names.select("name"), "name", "left_semi")


def known_features(features: DataFrame, domain: DataFrame) -> DataFrame:
    return features.join(domain.select("name").distinct(), "name", "left_semi")


def drop_features(features: DataFrame, names: list[str]) -> DataFrame:
    return features.where(~F.col("name").isin(names))


#: Names that a dense row may have.
MOST_DENSE = 100_000
MERGERS = {"ADD": F.sum, "MAX": F.max, "MIN": F.min, "AVERAGE": F.avg}


def merge_duplicates(features: DataFrame, how: str = "ADD", id_col: str = "id") -> DataFrame:
    """One value a name and row."""
    return features.groupBy(id_col, "name").agg(MERGERS[how]("value").alias("value"))


def unique_by_order(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """first, last, max, min and sum of ``value`` among rows of the same keys, first and last by ``order``; one partial aggregate, no sort."""
    return df.groupBy(*keys).agg(
        F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.max(value).alias("max"), F.min(value).alias("min"), F.sum(value).alias("sum"), F.count("*").alias("n")
    )


def densify(features: DataFrame, domain: DataFrame, id_col: str = "id") -> DataFrame:
    """Explicit zeros for all names of the domain: each row is widened once and unpivoted, so nothing is joined pair by pair.

    A domain of more than MOST_DENSE names is an error: rows that wide are no use, and would be cut short otherwise.
    """
    names = [r["name"] for r in domain.select("name").distinct().limit(MOST_DENSE + 1).collect()]
    if len(names) > MOST_DENSE:
        raise ValueError(f"a domain of more than {MOST_DENSE} names can't be made dense")
    names.sort()
    held = features.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    names_col = F.array(*[F.lit(n) for n in names])
    return held.select(id_col, F.explode(F.transform(names_col, lambda n: F.struct(n.alias("name"), F.coalesce(F.try_element_at("m", n), F.lit(0.0)).alias("value")))).alias("f")).select(id_col, "f.name", "f.value")


def is_dense(features: DataFrame, n_features: int, id_col: str = "id") -> DataFrame:
    """Rows with whether they have every feature."""
    return features.groupBy(id_col).agg((F.countDistinct("name") == n_features).alias("dense"))


def validate(features: DataFrame, id_col: str = "id") -> DataFrame:
    """Whether each row's feature names are unique and there is one at least."""
    return features.groupBy(id_col).agg((F.count("name") == F.countDistinct("name")).alias("valid"), F.count("name").alias("n"))


def weights_by_output(df: DataFrame, output: str, weights: dict[str, float], default: float = 1.0) -> DataFrame:
    column = F.lit(default)
    for label, w in weights.items():
        column = F.when(F.col(output) == label, w).otherwise(column)
    return df.withColumn("weight", column)


def domain_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names of one side only, with the side."""
    x, y = a.select("name").distinct(), b.select("name").distinct()
    return x.join(y, "name", "left_anti").withColumn("side", F.lit("first")).unionByName(y.join(x, "name", "left_anti").withColumn("side", F.lit("second")))


def output_domain(df: DataFrame, output: str) -> DataFrame:
    """output -> count, with dense ids in output order."""
    return position(df.groupBy(F.col(output).alias("output")).agg(F.count("*").alias("n")), [F.col("output")], "oid").withColumn("oid", F.col("oid").cast("int"))


def descriptive_stats(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, sample variance and deviation, min and max."""
    return df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
