"""Local explanations of a model's predictions: which words of a text, or columns of a row, a prediction rests on.

Copies of the example are perturbed on the cluster, the model predicts them all, and the few features of a
sparse linear fit, weighted by nearness, are the explanation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators.sparse_linear import Moments, forward_selection


def _kept(id_: Column, i: int, seed: int, share: float) -> Column:
    """Whether copy ``id_`` keeps part ``i``; the first copy is the example itself."""
    return (id_ == 0) | (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), id_), F.lit(1 << 20)) >= int(share * (1 << 20)))


def explain_text(predict, tokens: list[str], spark: SparkSession, n: int = 500, k: int = 5, width: float = 0.25, drop: float = 0.5, seed: int = 1) -> dict[str, float]:
    """Weights of the k tokens (as ``number:token``) that the prediction for a text rests on, and of ``bias``.

    predict: function of a table with ``text`` that adds ``y``.  Copies lack each token with probability ``drop``; a copy's
    nearness falls with the share of tokens that it lacks.
    """
    names = [f"{i}:{t}" for i, t in enumerate(tokens)]
    rows = spark.range(n).select("id", *[_kept(F.col("id"), i, seed, drop).cast("double").alias(f"t{i}") for i in range(len(tokens))])
    text = F.array_join(F.filter(F.array(*[F.when(F.col(f"t{i}") > 0, F.lit(t)) for i, t in enumerate(tokens)]), lambda t: t.isNotNull()), " ")
    lacking = 1 - sum((F.col(f"t{i}") for i in range(len(tokens))), F.lit(0.0)) / max(1, len(tokens))
    near = rows.withColumn("text", text).withColumn("near", F.exp(-lacking * lacking / (width * width)))
    found = forward_selection(Moments(predict(near), [f"t{i}" for i in range(len(tokens))], "y", "near"), k)
    return {names[int(c[1:])] if c[1:].isdigit() else c: w for c, w in found.items()}


def explain_columns(predict, df: DataFrame, example: dict, n: int = 500, k: int = 5, width: float = 0.75, keep: float = 0.5, seed: int = 1) -> dict[str, float]:
    """Weights of the k columns that the prediction for a row rests on, and of ``bias``: of 1 where a copy agrees with the example.

    predict: function of a table with the example's columns that adds ``y``.  A copy keeps each of the example's values with probability ``keep``
    and else takes that of a row of ``df``, drawn by a hash: so copies follow the table's own values, numbers and categories alike.
    """
    names, spark = sorted(example), df.sparkSession
    others = df.select(*names).orderBy(F.xxhash64(F.lit(seed), *names)).limit(n).collect()  # a bounded sample of n rows
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(others)], "id long, " + ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names))
    for i, c in enumerate(names):
        own = _kept(F.col("id"), i, seed, 1 - keep)
        rows = rows.withColumn(c, F.when(own, F.lit(example[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)))
        rows = rows.withColumn(f"same_{i}", F.col(c).eqNullSafe(F.lit(example[c]).cast(df.schema[c].dataType)).cast("double"))
    far = 1 - sum((F.col(f"same_{i}") for i in range(len(names))), F.lit(0.0)) / max(1, len(names))
    near = rows.withColumn("near", F.exp(-far * far / (width * width)))
    found = forward_selection(Moments(predict(near), [f"same_{i}" for i in range(len(names))], "y", "near"), k)
    return {names[int(c.removeprefix("same_"))] if c.startswith("same_") else c: w for c, w in found.items()}
