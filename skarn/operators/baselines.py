"""Closed-form models: dummy predictors, multinomial naive Bayes, combiners of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.sampling import running
from skarn.operators.scratch import Scratch
from skarn.operators.transforms import if_few


def dummy_classifier(df: DataFrame, label: str, kind: str = "MOST_FREQUENT", constant: str | None = None, key: Column | None = None, seed: int = 1) -> DataFrame:
    """``prediction`` for every row.

    MOST_FREQUENT (ties to the label that sorts first), CONSTANT, UNIFORM (over
    the labels) or STRATIFIED (by their shares); the last two by a hash of ``key``.
    """
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    if kind == "CONSTANT":
        return df.withColumn("prediction", F.lit(constant))
    if kind == "MOST_FREQUENT":
        best = counts.orderBy(F.desc("n"), "label").limit(1).select(F.col("label").alias("prediction"))
        return df.crossJoin(F.broadcast(best))  # one row
    labels = counts.orderBy("label").collect()  # the output domain
    weights = [r["n"] if kind == "STRATIFIED" else 1 for r in labels]
    u, total, upto, pick = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53), sum(weights), 0, None
    for r, w in zip(labels, weights):
        upto += w
        pick = F.when(u <= upto / total, r["label"]) if pick is None else pick.when(u <= upto / total, r["label"])
    return df.withColumn("prediction", pick)


def ranked_value(df: DataFrame, value: str, at) -> DataFrame:
    """One row: the value at 0-based sorted place ``at(n)``; found over counts of distinct values, cut into ranges, so no task sorts all rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = running(counts, [F.col("v")], ["c"]).withColumn("at", at(F.col("c_total")))
    return placed.where((F.col("c_upto") > F.col("at")) & (F.col("c_upto") - F.col("c") <= F.col("at"))).select(F.col("v").alias("value"))


def dummy_regressor(df: DataFrame, target: str, kind: str = "MEAN", quartile: float = 0.5, constant: float = 0.0) -> DataFrame:
    """One row, ``value``: what every row gets.  MEAN, MEDIAN (sorted[n / 2]), QUARTILE (sorted[floor(q n)]) or CONSTANT; nothing is interpolated."""
    if kind == "MEAN":
        return df.agg(F.avg(target).alias("value"))
    if kind == "CONSTANT":
        return df.sparkSession.range(1).select(F.lit(constant).alias("value"))
    share = 0.5 if kind == "MEDIAN" else quartile
    return ranked_value(df, target, lambda n: F.floor(n / 2) if kind == "MEDIAN" else F.least(F.floor(n * share), n - 1))


def mnb_fit(features: DataFrame, labels: DataFrame | None = None, id_col: str = "id", label: str = "label", weight: str | None = None, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes without class prior: (label, name, logp) and (label, logp of a name unseen with the label).

    labels: a table of the rows' labels; None: the long features carry ``label`` (and ``weight``) themselves, which spares a join of every feature.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    if labels is None:
        joined = features.select(F.col(label).alias("label"), "name", "value", w.alias("w"))
    else:
        joined = features.join(labels.select(id_col, F.col(label).alias("label"), w.alias("w")), id_col)
    mass = Scratch(features.sparkSession).write(joined.groupBy("label", "name").agg(F.sum(F.col("w") * F.col("value")).alias("mass")), "mass")  # read for each of the sums
    size = mass.select("name").distinct().agg(F.count("*").alias("size"))
    total = mass.groupBy("label").agg(F.sum("mass").alias("total")).crossJoin(F.broadcast(size))  # one row
    base = F.col("total") + alpha * F.col("size")
    seen = mass.join(F.broadcast(total), "label").select("label", "name", F.ln((F.col("mass") + alpha) / base).alias("logp"))
    unseen = total.select("label", F.ln(F.lit(alpha) / base).alias("unseen"))
    return seen, unseen


def mnb_score(features: DataFrame, model: tuple[DataFrame, DataFrame], id_col: str = "id") -> DataFrame:
    """(id, label, score): log likelihood of each row under each label.  One join with the model, by name, and one sum by row; a row without a known name has no score."""
    seen, unseen = model
    labels = unseen.orderBy("label").collect()  # the output domain
    gains = [F.coalesce(F.max(F.when(F.col("label") == r["label"], F.col("logp") - r["unseen"])), F.lit(0.0)).alias(f"gain_{i}") for i, r in enumerate(labels)]
    names = if_few(seen.groupBy("name").agg(*gains))
    sums = features.join(names, "name").groupBy(id_col).agg(F.sum("value").alias("mass"), *[F.sum(F.col("value") * F.col(f"gain_{i}")).alias(f"gain_{i}") for i in range(len(labels))])
    every = F.array(*[F.struct(F.lit(r["label"]).alias("label"), (F.col(f"gain_{i}") + F.col("mass") * r["unseen"]).alias("score")) for i, r in enumerate(labels)])
    return sums.select(id_col, F.explode(every).alias("s")).select(id_col, "s.label", "s.score")


def best_label(scores: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, prediction): the greatest score, ties to the label that sorts first; a partial aggregate."""
    top = scores.groupBy(id_col).agg(F.min_by("label", F.struct((-F.round("score", 9)).alias("s"), F.col("label"))).alias("prediction"))
    return top


def vote(predictions: DataFrame, id_col: str, prediction: str, weight: Column | None = None) -> DataFrame:
    """(id, prediction, votes): one (weighted) vote for each member, ties to the label that sorts first."""
    v = predictions.groupBy(id_col, F.col(prediction).alias("prediction")).agg(F.sum(weight if weight is not None else F.lit(1)).alias("votes"))
    top = v.groupBy(id_col).agg(F.min_by(F.struct("prediction", "votes"), F.struct((-F.col("votes")).alias("v"), F.col("prediction"))).alias("b"))
    return top.select(id_col, "b.prediction", "b.votes")


def average(predictions: DataFrame, id_col: str, value: str, weight: Column | None = None) -> DataFrame:
    """(id, mean, variance): weighted mean of the members and their population variance."""
    if weight is None:
        return predictions.groupBy(id_col).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    p = predictions.select(id_col, F.col(value).cast("double").alias("y"), weight.alias("w"))
    mean = p.groupBy(id_col).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean"))
    # around the mean: differences of squares would cancel
    off = F.col("y") - F.col("mean")
    return p.join(mean, id_col).groupBy(id_col, "mean").agg((F.sum(F.col("w") * off * off) / F.sum("w")).alias("variance"))


def multilabel_vote(predictions: DataFrame, id_col: str, labels: str, members: int) -> DataFrame:
    """(id, labels): those that more than half of the members predict."""
    v = predictions.select(id_col, F.explode(labels).alias("label")).groupBy(id_col, "label").agg(F.count("*").alias("n")).where(F.col("n") * 2 > members)
    return v.groupBy(id_col).agg(F.array_sort(F.collect_set("label")).alias("labels"))
