"""Evaluation metrics: classification, ranking curves, regression, anomaly, multi-label, clustering.

Predictions are rows; each evaluation first turns them into counts (or moments)
by partial aggregates, and works on those.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.scalars import ratio
from skarn.operators.sampling import running


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n)."""
    return df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def label_counts(matrix: DataFrame) -> DataFrame:
    """tp, fp, fn, tn and support of each label of the domain (labels of either side), from a confusion matrix."""
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("truth") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn"), F.col("n").alias("total")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col("truth") != F.col("predicted"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("total")),
    )
    by = matrix.select(F.explode(sides).alias("s")).select("s.*").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "total")])
    n = F.sum("total").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # over labels, not rows
    return by.select("label", "tp", "fp", "fn", (n - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), F.col("total").alias("support"))


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return ratio((1 + b) * p * r, b * p + r)


def label_metrics(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """precision, recall, f-beta (0 on 0/0) and accuracy (the label's recall; NaN without support) by label."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", p.alias("precision"), r.alias("recall"), f_beta(p, r, beta).alias("f"), ratio(F.col("tp"), F.col("support"), math.nan).alias("accuracy"))


def averages(counts: DataFrame) -> DataFrame:
    """One row: micro and macro precision, recall and F1, accuracy, and the balanced error rate over the domain."""
    by = label_metrics(counts)
    s = by.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")], *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select(
        p.alias("micro_precision"), r.alias("micro_recall"), f_beta(p, r).alias("micro_f1"), "macro_precision", "macro_recall", F.col("macro_f").alias("macro_f1"), ratio(F.col("tp"), F.col("support"), math.nan).alias("accuracy"), (1 - F.col("macro_recall")).alias("balanced_error_rate")
    )


def roc_points(df: DataFrame, positive: Column, score: Column, digits: int = 12) -> DataFrame:
    """(threshold, tp, fp, positives, negatives) at each distinct score, downwards.

    Rows are first counted by score; the running sums go over ranges of scores,
    each range summed by itself and set off by the sums of those above, so no task sees all thresholds.
    """
    by = df.select(F.round(score.cast("double"), digits).alias("threshold"), positive.cast("int").alias("pos")).groupBy("threshold").agg(F.sum("pos").cast("long").alias("p"), F.sum(1 - F.col("pos")).cast("long").alias("q"))
    found = running(by, [F.desc("threshold")], ["p", "q"])
    return found.select("threshold", F.col("p_upto").alias("tp"), F.col("q_upto").alias("fp"), F.col("p_total").alias("positives"), F.col("q_total").alias("negatives"), F.col("p").alias("dp"), F.col("q").alias("dq"))


def auroc(points: DataFrame) -> DataFrame:
    """One row: the trapezoid area under the ROC curve."""
    x = F.col("dq") * (F.col("tp") - F.col("dp") / 2)
    return points.agg((F.sum(x) / (F.max("positives") * F.max("negatives"))).alias("auroc"))


def pr_points(points: DataFrame) -> DataFrame:
    """(threshold, precision, recall) up to the first threshold with all positives."""
    before = F.col("tp") - F.col("dp")
    return points.where(before < F.col("positives")).select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("positives")).alias("recall"), F.col("dp"), "positives")


def average_precision(points: DataFrame) -> DataFrame:
    """One row: sum of recall steps times precision."""
    return pr_points(points).agg(F.sum(F.col("dp") / F.col("positives") * F.col("precision")).alias("average_precision"))


def regression(df: DataFrame, truth: Column, predicted: Column, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """rmse, mae, r2 and explained_variance; one aggregation.

    Rows whose truth or prediction is null take no part.  Without weights the variances are merged around the
    mean; with weights they are differences of moments, which lose digits where the mean is far from 0.
    """
    df, plain = df.where((truth - predicted).isNotNull()), weight is None
    w = weight if weight is not None else F.lit(1.0)
    e = truth - predicted
    m = df.groupBy(*(by or [])).agg(F.sum(w).alias("w"), F.sum(w * e).alias("e"), F.sum(w * e * e).alias("ee"), F.sum(w * F.abs(e)).alias("ae"), F.sum(w * truth).alias("y"), F.sum(w * truth * truth).alias("yy"), F.var_pop(truth).alias("vy"), F.var_pop(e).alias("ve"))
    var_y = F.col("vy") if plain else F.col("yy") / F.col("w") - F.pow(F.col("y") / F.col("w"), F.lit(2))
    var_e = F.col("ve") if plain else F.col("ee") / F.col("w") - F.pow(F.col("e") / F.col("w"), F.lit(2))
    return m.select(*(by or []), F.sqrt(F.col("ee") / F.col("w")).alias("rmse"), (F.col("ae") / F.col("w")).alias("mae"), (1 - F.col("ee") / F.col("w") / var_y).alias("r2"), (1 - var_e / var_y).alias("explained_variance"))


def anomaly(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, tn, fn, precision, recall and f1 of the anomalous class; NaN on 0/0."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    c = df.agg(n(truth & predicted).alias("tp"), n(~truth & predicted).alias("fp"), n(~truth & ~predicted).alias("tn"), n(truth & ~predicted).alias("fn"))
    nan = float("nan")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), nan), ratio(F.col("tp"), F.col("tp") + F.col("fn"), nan)
    return c.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r, nan).alias("f1"))


def multilabel_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn by label of two array columns."""
    n = df.count()
    marks = F.transform(F.array_union(truth, predicted), lambda l: F.struct(l.alias("label"), F.array_contains(truth, l).alias("t"), F.array_contains(predicted, l).alias("p")))
    long = df.select(F.explode(marks).alias("m")).select("m.*")
    s = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    by = long.groupBy("label").agg(s(F.col("t") & F.col("p")).alias("tp"), s(~F.col("t") & F.col("p")).alias("fp"), s(F.col("t") & ~F.col("p")).alias("fn"))
    return by.select("*", (F.lit(n) - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), (F.col("tp") + F.col("fn")).alias("support"))


def clustering(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: nmi (by the lesser entropy) and ami, both in nats.  Only class sizes and the table of counts reach the driver."""
    cells = [(r[0], r[1], r[2]) for r in df.groupBy(truth, predicted).count().collect()]
    rows, cols, n = {}, {}, 0
    for a, b, k in cells:
        rows[a], cols[b], n = rows.get(a, 0) + k, cols.get(b, 0) + k, n + k
    mi = sum(k / n * math.log(k * n / (rows[a] * cols[b])) for a, b, k in cells)
    h = [-sum(k / n * math.log(k / n) for k in side.values()) for side in (rows, cols)]
    from skarn.operators.infotheory import expected_mutual_information

    expected = expected_mutual_information(list(rows.values()), list(cols.values())) if n else 0.0
    low = min(h)
    gap = low - expected
    gap = math.copysign(max(abs(gap), 2.220446049250313e-16), gap)
    return df.sparkSession.createDataFrame([(mi / low if low else math.nan, (mi - expected) / gap)], "nmi double, ami double")


def summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric, over evaluations (rows): mean, sample deviation, min and max."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def best(evaluations: DataFrame, metric: str, name: str, highest: bool = True) -> DataFrame:
    """One row: the evaluation with the highest (or lowest) value of a metric, ties to the first name; null and NaN never win."""
    known = evaluations.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    return known.orderBy(F.desc(metric) if highest else F.asc(metric), name).limit(1).select(name, metric)
