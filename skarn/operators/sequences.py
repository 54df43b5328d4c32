"""Sequence labelling: preceding-label features, a first-order label model, Viterbi decoding by sequence.

Training is counting (partial aggregates bounded by labels and features);
decoding runs in each sequence's own group, with the counts as a broadcast of
labels x features that is checked for size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START = "<start>"


def preceding_labels(df: DataFrame, seq: str, order: list[str], label: str, k: int = 2) -> DataFrame:
    """Columns prev_1 .. prev_k (null before the start) and their joined history."""
    w = Window.partitionBy(seq).orderBy(*order)
    out = df
    for i in range(1, k + 1):
        out = out.withColumn(f"prev_{i}", F.lag(label, i).over(w))
    return out.withColumn("history", F.concat_ws("/", *[f"prev_{i}" for i in range(k, 0, -1)]))


def flatten(df: DataFrame, seq: str, items: str) -> DataFrame:
    """One row an element of an array column of sequences, with its ``pos`` from 0."""
    return df.select(*[c for c in df.columns if c != items], F.posexplode(items).alias("pos", "item"))


def fit_chain(df: DataFrame, seq: str, order: list[str], feature: str, label: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(before, label, logp) of transitions and (label, feature, logp) of emissions, with additive smoothing over what was seen."""
    before = F.coalesce(F.lag(label).over(Window.partitionBy(seq).orderBy(*order)), F.lit(START))
    rows = df.select(before.alias("before"), F.col(label).alias("label"), F.col(feature).cast("string").alias("feature"))
    n_labels, n_features = (rows.agg(F.countDistinct(c)).first()[0] for c in ("label", "feature"))

    def logs(keys, total, size):
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        sums = counts.groupBy(total).agg(F.sum("n").alias("total"))
        return counts.join(sums, total).select(*keys, F.ln((F.col("n") + alpha) / (F.col("total") + alpha * size)).alias("logp"))

    return logs(["before", "label"], "before", n_labels), logs(["label", "feature"], "label", n_features)


def viterbi(df: DataFrame, model: tuple[DataFrame, DataFrame], seq: str, order: list[str], feature: str, most_rows: int = 2_000_000) -> DataFrame:
    """The rows with ``prediction``, the best label path of their sequence.

    The model goes to the tasks whole; a model of more than ``most_rows`` counts is refused.
    Sequences are decoded in their own groups; ties go to the label that sorts first.
    """
    transitions, emissions = model
    if (n := emissions.count() + transitions.count()) > most_rows:
        raise ValueError(f"a model of {n} counts is beyond the bound of {most_rows}")
    t, e = {(r.before, r.label): r.logp for r in transitions.collect()}, {(r.label, r.feature): r.logp for r in emissions.collect()}
    labels = sorted({b for _, b in t})
    floor = min([*t.values(), *e.values()], default=0.0) - 1.0
    held = df.sparkSession.sparkContext.broadcast((t, e, labels, floor))

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        t, e, labels, floor = held.value
        pdf = pdf.sort_values(order)
        if not labels:
            return pdf.assign(prediction=None)
        step = np.array([[t.get((a, b), floor) for b in labels] for a in labels])
        score, back = None, []
        for x in pdf[feature].astype(str):
            emit = np.array([e.get((b, x), floor) for b in labels])
            if score is None:
                score = np.array([t.get((START, b), floor) for b in labels]) + emit
                continue
            paths = score[:, None] + step
            back.append(paths.argmax(axis=0))
            score = paths.max(axis=0) + emit
        at = [int(score.argmax())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        return pdf.assign(prediction=[labels[i] for i in reversed(at)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", prediction string"
    return df.groupBy(seq).applyInPandas(decode, schema)
