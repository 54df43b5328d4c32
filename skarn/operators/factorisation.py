"""Factorisation machines: a linear model and products of all pairs of features, by factors of few dimensions.

The score of an output is b + w.x + sum over pairs i < j of (v_i . v_j) x_i x_j, which takes one pass over the features.
Training is that of ``linear``, with any of its objectives and optimisers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.operators.linear import OBJECTIVES, Optimiser, descend, encoded, matrix


def _split(p: np.ndarray, n_in: int, n_out: int, factors: int):
    """Biases (outputs), weights (features, outputs) and factors (outputs, features, factors) of a flat vector."""
    a, b = n_out, n_out + n_in * n_out
    return p[:a], p[a:b].reshape(n_in, n_out), p[b:].reshape(n_out, n_in, factors)


def scores(x: np.ndarray, p: np.ndarray, n_out: int, factors: int) -> np.ndarray:
    bias, w, v = _split(p, x.shape[1], n_out, factors)
    pairs = [((x @ f) ** 2 - (x * x) @ (f * f)).sum(axis=1) / 2 for f in v]
    return bias + x @ w + np.column_stack(pairs)


def gradient(x: np.ndarray, g: np.ndarray, p: np.ndarray, factors: int) -> np.ndarray:
    """Gradient by the parameters, given the gradient ``g`` by the scores."""
    _, _, v = _split(p, x.shape[1], g.shape[1], factors)
    dv = [x.T @ (g[:, [o]] * (x @ f)) - ((x * x).T @ g[:, [o]]) * f for o, f in enumerate(v)]
    return np.concatenate([g.sum(axis=0), (x.T @ g).ravel(), np.array(dv).ravel()])


class FactorisationMachine:
    def __init__(self, parameters: np.ndarray, n_in: int, outputs: list[str], factors: int, objective: str):
        self.parameters, self.n_in, self.outputs, self.factors, self.objective = parameters, n_in, outputs, factors, objective

    def predict(self, df: DataFrame, features: str, threshold: float | None = None) -> DataFrame:
        """``df`` with ``scores`` by output and ``prediction``: the best output (ties to the first), or the array of those above the threshold; null features give nulls."""
        p, n_out, factors, names = self.parameters, len(self.outputs), self.factors, np.array(self.outputs, object)
        schema = T.StructType([*df.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("prediction", T.StringType() if threshold is None else T.ArrayType(T.StringType()))])

        def run(batches):
            for b in batches:
                column = b.column(features)
                known = column.is_valid().to_numpy(zero_copy_only=False)
                z, out, at = [None] * b.num_rows, [None] * b.num_rows, np.flatnonzero(known)
                if len(at):
                    s = scores(column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1), p, n_out, factors)
                    for i, row in zip(at.tolist(), s):
                        z[i] = row
                        out[i] = names[row.argmax()] if threshold is None else names[row > threshold].tolist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z, pa.list_(pa.float64())), pa.array(out, pa.string() if threshold is None else pa.list_(pa.string()))], names=[*b.schema.names, "scores", "prediction"])

        return df.withColumn(features, F.col(features).cast("array<double>")).mapInArrow(run, T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == features else f.dataType) for f in schema]))


def fit(df: DataFrame, features: str, target: str, outputs: list[str], objective: str = "log", factors: int = 4, optimiser: Optimiser | None = None, epochs: int = 30, variance: float = 0.1, seed: int = 1, weight: str | None = None) -> FactorisationMachine:
    """Trains on array columns, as ``linear.fit`` does: labels (log, hinge), several labels (binary), real targets (squared, absolute, huber).

    Weights start at 0 and factors at normal random numbers of deviation ``variance``, by ``seed``.
    """
    rows, n_in = encoded(df, features, target, outputs, weight)
    n_out, loss = len(outputs), OBJECTIVES[objective]
    start = np.zeros(n_out + n_in * n_out * (1 + factors))
    start[n_out + n_in * n_out :] = np.random.default_rng(seed).normal(0, variance, n_in * n_out * factors)

    def step(b, p):
        x, u = matrix(b, "x"), b.column("w").to_numpy()
        _, g = loss(scores(x, p, n_out, factors), matrix(b, "y"))
        return gradient(x, g * u[:, None], p, factors), u.sum()

    p = descend(rows, start, step, optimiser or Optimiser("adam", 0.05), epochs)
    rows.unpersist()
    return FactorisationMachine(p, n_in, outputs, factors, objective)
