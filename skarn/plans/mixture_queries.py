"""Gaussian mixtures over all embeddings, with the SQL of their rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skarn.operators import mixtures
from skarn.plans.feature_queries import table

ROUNDS, JITTER = 2, 1e-6


def mixture_rounds(spark, sf_dir):
    """Shares and, by dimension, means and variances of a diagonal mixture after some rounds from the labels' means."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    labels = e.where("label IS NOT NULL").groupBy("label").agg(F.count("*"))
    start = e.where("label IS NOT NULL").select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    names = sorted((r.label for r in labels.collect()), key=int)
    means = np.zeros((len(names), 1 + max(r.i for r in start.select("i").distinct().collect())))
    for r in start.collect():  # a number for each label and dimension
        means[names.index(r.label), r.i] = r.x
    m = mixtures.fit(e, "v", len(names), "diagonal", ROUNDS, least_gain=-np.inf, jitter=JITTER, means=means)
    rows = [(names[j], i, round(float(m.shares[j]), 6), round(float(m.means[j, i]), 6), round(float(m.covariances[j, i]), 6)) for j in range(len(names)) for i in range(means.shape[1])]
    return spark.createDataFrame(rows, "label string, i int, share double, mean double, variance double")


def _sql() -> str:
    parts = [
        "e AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings)",
        "m0 AS MATERIALIZED (SELECT label, i, avg(x) AS mean, 1.0::DOUBLE AS variance, 1.0::DOUBLE / (SELECT count(DISTINCT label) FROM embeddings) AS share FROM e WHERE label IS NOT NULL GROUP BY 1, 2)",
    ]
    for r in range(ROUNDS):
        parts.append(f"z{r} AS MATERIALIZED (SELECT e.vec_id, m.label, ln(any_value(m.share)) - sum((e.x - m.mean) ** 2 / m.variance + ln(m.variance)) / 2 AS z FROM e JOIN m{r} m USING (i) GROUP BY 1, 2)")
        parts.append(f"t{r} AS MATERIALIZED (SELECT vec_id, max(z) AS top FROM z{r} GROUP BY 1)")
        parts.append(f"r{r} AS MATERIALIZED (SELECT vec_id, label, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY vec_id) AS r FROM z{r} JOIN t{r} USING (vec_id))")
        parts.append(f"s{r} AS MATERIALIZED (SELECT label, sum(r) AS n FROM r{r} GROUP BY 1)")
        parts.append(f"n{r} AS MATERIALIZED (SELECT r.label, e.i, sum(r.r * e.x) / any_value(s.n) AS mean FROM r{r} r JOIN e USING (vec_id) JOIN s{r} s ON s.label = r.label GROUP BY 1, 2)")
        parts.append(f"m{r + 1} AS MATERIALIZED (SELECT n.label, n.i, any_value(n.mean) AS mean, sum(r.r * (e.x - n.mean) ** 2) / any_value(s.n) + {JITTER} AS variance, any_value(s.n) / (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS share FROM n{r} n JOIN r{r} r USING (label) JOIN e ON e.vec_id = r.vec_id AND e.i = n.i JOIN s{r} s ON s.label = n.label GROUP BY 1, 2)")
    return "WITH " + ",\n".join(parts) + f" SELECT label, CAST(i AS INTEGER) AS i, round(share, 6) AS share, round(mean, 6) AS mean, round(variance, 6) AS variance FROM m{ROUNDS}"


QUERIES = {"mixture_rounds": (mixture_rounds, _sql())}
