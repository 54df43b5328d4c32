"""Linear models by distributed full-gradient steps or mini-batches, for any objective and optimiser.

A step is one pass: each task adds up its rows' loss and gradient with the
weights it was sent; partial gradients are summed by a shuffle keyed by
parameter.  What the driver holds is the parameters (features x outputs), whose number is checked.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PARAMETERS = 5_000_000


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: (scores, one-hot or real targets) -> (losses by row, gradient by score)
OBJECTIVES = {
    "log": lambda z, y: (-np.log(np.maximum((_softmax(z) * y).sum(axis=1), 1e-300)), _softmax(z) - y),
    "hinge": lambda z, y: _hinge(z, y),
    "squared": lambda z, y: (((z - y) ** 2).sum(axis=1) / 2, z - y),
    "absolute": lambda z, y: (np.abs(z - y).sum(axis=1), np.sign(z - y)),
    "huber": lambda z, y: _huber(z - y, 5.0),
    "binary": lambda z, y: ((np.logaddexp(0, z) - z * y).sum(axis=1), 1 / (1 + np.exp(-z)) - y),
    "binary_hinge": lambda z, y: (np.maximum(0, 1 - (2 * y - 1) * z).sum(axis=1), np.where((2 * y - 1) * z < 1, 1 - 2 * y, 0.0)),
}


def _hinge(z, y):
    true = (z * y).sum(axis=1)
    other = np.where(y > 0, -np.inf, z)
    rival = other.argmax(axis=1)
    loss = np.maximum(0, 1 - true + other[np.arange(len(z)), rival])
    g = np.zeros_like(z)
    g[np.arange(len(z)), rival] = 1
    return loss, (g - y) * (loss > 0)[:, None]


def _huber(e, cost):
    far = np.abs(e) > cost
    return np.where(far, cost * np.abs(e) - cost * cost / 2, e * e / 2).sum(axis=1), np.where(far, cost * np.sign(e), e)


class Optimiser:
    """Turns the t-th gradient (from 1) into the step to subtract."""

    def __init__(self, kind: str = "adagrad", rate: float = 0.5, decay: str = "constant", momentum: float = 0.0, rho: float = 0.95, l2: float = 0.0):
        self.kind, self.rate, self.decay, self.momentum, self.rho, self.l2 = kind, rate, decay, momentum, rho, l2
        self.a = self.b = 0.0

    def step(self, g: np.ndarray, t: int) -> np.ndarray:
        rate = self.rate / {"constant": 1, "linear": t, "sqrt": t**0.5}[self.decay]
        if self.kind == "sgd":
            self.a = self.momentum * self.a + rate * g
            return self.a
        if self.kind == "pegasos":
            return g / (max(self.l2, 1e-6) * t)
        if self.kind == "adagrad":
            self.a = self.a + g * g
            return rate * g / (np.sqrt(self.a) + 1e-6)
        if self.kind == "rmsprop":
            self.a = self.rho * self.a + (1 - self.rho) * g * g
            return rate * g / (np.sqrt(self.a) + 1e-8)
        if self.kind == "adadelta":
            self.a = self.rho * self.a + (1 - self.rho) * g * g
            d = np.sqrt(self.b + 1e-6) / np.sqrt(self.a + 1e-6) * g
            self.b = self.rho * self.b + (1 - self.rho) * d * d
            return d
        if self.kind == "adam":
            self.a, self.b = 0.9 * self.a + 0.1 * g, 0.999 * self.b + 0.001 * g * g
            return rate * (self.a / (1 - 0.9**t)) / (np.sqrt(self.b / (1 - 0.999**t)) + 1e-8)
        raise ValueError(self.kind)


class Linear:
    """Weights (features and a bias, by output)."""

    def __init__(self, weights: np.ndarray, outputs: list[str], objective: str):
        self.weights, self.outputs, self.objective = weights, outputs, objective

    def scores(self, df: DataFrame, features: str) -> DataFrame:
        """``df`` with ``scores``: array of the outputs' scores (probabilities for log and binary), in the order of ``outputs``."""
        sent, shown = df.sparkSession.sparkContext.broadcast(self.weights), {"log": _softmax, "binary": lambda z: 1 / (1 + np.exp(-z))}.get(self.objective, lambda z: z)

        @F.arrow_udf("array<double>")
        def scored(x: pa.Array) -> pa.Array:
            w, known = sent.value, np.asarray(x.is_valid())
            rows = x.filter(pa.array(known))
            z = shown(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) @ w[:-1] + w[-1]) if len(rows) else np.empty((0, w.shape[1]))
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, w.shape[1], dtype=np.int32)), pa.array(z.ravel()))
            return made.take(pa.array(np.maximum(np.cumsum(known) - 1, 0), mask=~known))

        return df.withColumn("scores", scored(F.col(features).cast("array<double>")))

    def predict(self, df: DataFrame, features: str, threshold: float | None = None) -> DataFrame:
        """``prediction``: the best output (ties to the first); with a threshold, the array of outputs above it."""
        out = self.scores(df, features)
        names = F.array(*[F.lit(o) for o in self.outputs])
        if threshold is not None:
            kept = F.filter(F.transform(names, lambda n, i: F.when(F.get("scores", i) > threshold, n)), lambda n: n.isNotNull())
            return out.withColumn("prediction", F.array_sort(kept))
        return out.withColumn("prediction", F.get(names, F.array_position("scores", F.array_max("scores")).cast("int") - 1))

    def top_features(self, names: list[str], n: int) -> list[tuple[str, str, float]]:
        """(output, feature, weight): the n greatest weights by size of each output."""
        return [(o, names[i], float(self.weights[i, j])) for j, o in enumerate(self.outputs) for i in np.argsort(-np.abs(self.weights[:-1, j]), kind="stable")[:n].tolist()]


def descend(rows: DataFrame, start: np.ndarray, gradient, optimiser: Optimiser, epochs: int, average: bool = False, done: int = 0) -> np.ndarray:
    """Full-gradient descent over a flat vector of parameters.

    gradient: (batch, parameters) -> (sum of the rows' weighted gradients, sum of their weights), run in the tasks; a
    pass sums them by parameter.  average: the mean of the steps' parameters.  done: steps that the optimiser took before.
    """
    if len(start) > MOST_PARAMETERS:
        raise ValueError(f"{len(start)} parameters are beyond the bound of {MOST_PARAMETERS}")
    w, mean = start.copy(), np.zeros_like(start)
    for t in range(done + 1, done + epochs + 1):
        sent = rows.sparkSession.sparkContext.broadcast(w)

        def run(batches, sent=sent):
            total, size = np.zeros(len(sent.value)), 0.0
            for b in batches:
                g, n = gradient(b, sent.value)
                total, size = total + g, size + n
            flat = np.append(total, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "g"])

        g = np.zeros(len(w) + 1)
        for r in rows.mapInArrow(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toLocalIterator():
            g[r.i] = r.g
        w = w - optimiser.step(g[:-1] / max(g[-1], 1e-12) + optimiser.l2 * w, t)
        mean += (w - mean) / (t - done)
        sent.unpersist()
    return mean if average else w


def descend_in_batches(rows: DataFrame, key: str, start: np.ndarray, gradient, optimiser: Optimiser, epochs: int, batch: int, shards: int, seed: int) -> np.ndarray:
    """Mini-batch descent: each shard of the rows is streamed in a shuffled order, a step for every ``batch`` rows, and the shards' models are averaged after each epoch.

    Shards (by a hash of ``key``, their number a parameter) and orders (by a hash of key, seed and epoch) don't depend on the
    partitioning, nor do batches on Arrow's; averages are taken in the order of the shards, weighted by their rows.  So a seed gives one model on any cluster.
    The optimiser's sums are averaged with the parameters, and its steps count on.  A task holds a batch and the parameters; the driver one shard's at a time.
    """
    if len(start) > MOST_PARAMETERS:
        raise ValueError(f"{len(start)} parameters are beyond the bound of {MOST_PARAMETERS}")
    n, steps = len(start), 0
    state = np.concatenate([start, np.zeros(2 * n)])
    shard = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(shards)).cast("int")
    for epoch in range(epochs):
        sent = rows.sparkSession.sparkContext.broadcast((state, steps))

        def run(batches, sent=sent):
            own, held = None, []
            model = count = t = None

            def step(some):
                nonlocal t
                t += 1
                g, u = gradient(some, model[0])
                if u > 0:
                    model[1].a, model[1].b = model[2], model[3]
                    model[0] = model[0] - model[1].step(g / u + optimiser.l2 * model[0], t)
                    model[2], model[3] = model[1].a, model[1].b

            def drained(last):
                nonlocal held
                if held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    at = 0
                    while table.num_rows - at >= batch or (last and at < table.num_rows):
                        step(table.slice(at, batch).combine_chunks().to_batches()[0])
                        at += batch
                    held = table.slice(at).to_batches()

            def finished():
                drained(True)
                full = [np.broadcast_to(np.asarray(v, float), n) for v in (model[0], model[2], model[3])]
                return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([count]), pa.array([t]), pa.array([np.concatenate(full).tobytes()], pa.binary())], names=["shard", "n", "t", "state"])

            for b in batches:
                numbers = b.column("shard").to_numpy()
                for first in np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])).tolist() if len(numbers) else []:
                    some = b.slice(first, int((numbers[first:] == numbers[first]).sum()))
                    if own != int(numbers[first]):
                        if own is not None:
                            yield finished()
                        own, held, count, t = int(numbers[first]), [], 0, sent.value[1]
                        w, a, c = sent.value[0].reshape(3, n)
                        model = [w, copy.copy(optimiser), a, c]
                    held.append(some)
                    count += some.num_rows
                    if sum(x.num_rows for x in held) >= batch:
                        drained(False)
            if own is not None:
                yield finished()

        order = [F.xxhash64(F.lit(seed), F.lit(epoch), key), F.col(key)]
        dealt = rows.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("shard", *order)
        mean, total, steps_now = np.zeros(3 * n), 0, steps
        for r in dealt.mapInArrow(run, "shard int, n long, t long, state binary").orderBy("shard").toLocalIterator():
            total += r.n
            mean += (np.frombuffer(r.state) - mean) * (r.n / total)
            steps_now = max(steps_now, r.t)
        state, steps = mean, steps_now
        sent.unpersist()
    return state[:n]


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of lists of one length as the rows of a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def encoded(df: DataFrame, features: str, target: str, outputs: list[str], weight: str | None = None, key: str | None = None) -> tuple[DataFrame, int]:
    """(x, y, w, and the key if there is one): features, one-hot labels (or several, or real targets) and weights of the rows that have both; the number of features."""
    kind = dict(df.dtypes)[target]
    if kind == "string":
        y = F.array(*[(F.col(target) == o).cast("double") for o in outputs])
    elif kind == "array<string>":
        y = F.array(*[F.array_contains(target, o).cast("double") for o in outputs])
    else:
        y = F.col(target).cast("array<double>")
    rows = df.select(F.col(features).cast("array<double>").alias("x"), y.alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), F.col(target).isNotNull().alias("known"), *([F.col(key).alias("key")] if key else [])).where("x IS NOT NULL AND known").drop("known").cache()
    first = rows.first()
    if first is None:
        raise ValueError("no rows to learn from")
    return rows, len(first.x)


def fit(df: DataFrame, features: str, target: str, outputs: list[str], objective: str = "log", optimiser: Optimiser | None = None, epochs: int = 30, weight: str | None = None, average: bool = False, start: Linear | None = None, batch: int | None = None, key: str | None = None, shards: int = 32, seed: int = 1) -> Linear:
    """Trains on array columns: ``features`` of doubles; ``target`` a label of ``outputs``, an array of labels (binary objectives) or an array of doubles (regression).

    start: a model to go on from, so that new rows are learnt step by step as they come.
    batch: rows of a step, in shards (see ``descend_in_batches``; ``key`` is a column that tells rows apart); without it a step takes all rows.
    """
    if batch and not key:
        raise ValueError("batches need a key")
    rows, n_in = encoded(df, features, target, outputs, weight, key if batch else None)
    shape, loss = (n_in + 1, len(outputs)), OBJECTIVES[objective]

    def gradient(b, w):
        x = np.hstack([matrix(b, "x"), np.ones((b.num_rows, 1))])
        u = b.column("w").to_numpy()
        _, g = loss(x @ w.reshape(shape), matrix(b, "y"))
        return (x.T @ (g * u[:, None])).ravel(), u.sum()

    first = np.zeros(shape).ravel() if start is None else start.weights.ravel()
    if batch:
        w = descend_in_batches(rows, "key", first, gradient, optimiser or Optimiser(), epochs, batch, shards, seed)
    else:
        w = descend(rows, first, gradient, optimiser or Optimiser(), epochs, average)
    rows.unpersist()
    return Linear(w.reshape(shape), outputs, objective)
