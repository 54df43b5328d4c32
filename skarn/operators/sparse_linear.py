"""Sparse linear regression from moments: one distributed pass gives the Gram matrix, and the paths run on that.

The moments are features x features in size, however many rows there are; the number of features is checked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_FEATURES = 2000


class Moments:
    """n, means and centred cross products of standardised features and the target."""

    def __init__(self, df: DataFrame, names: list[str], target: str, weight: str | None = None):
        if len(names) > MOST_FEATURES:
            raise ValueError(f"{len(names)} features are beyond the bound of {MOST_FEATURES}")
        self.names, k = names, len(names) + 2
        rows = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in [*names, target]]).alias("v"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))

        def add(batches):
            total = np.zeros((k, k))
            for b in batches:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                w = b.column("w").to_numpy()
                ok = ~np.isnan(v).any(axis=1)
                x = np.hstack([np.ones((ok.sum(), 1)), v[ok]])
                total += x.T @ (x * w[ok, None])
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([pa.array(i * k + j), pa.array(total[i, j])], names=["i", "s"])

        m = np.zeros((k, k))
        for r in rows.mapInArrow(add, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toLocalIterator():
            m[divmod(r.i, k)] = m[divmod(r.i, k)[::-1]] = r.s
        self.n = max(m[0, 0], 1e-12)
        mean = m[0, 1:] / self.n
        c = m[1:, 1:] / self.n - np.outer(mean, mean)
        self.scale = np.sqrt(np.maximum(np.diag(c)[:-1], 0))
        self.scale[self.scale == 0] = 1
        self.mean, self.y_mean = mean[:-1], mean[-1]
        self.gram = c[:-1, :-1] / np.outer(self.scale, self.scale)
        self.xy = c[:-1, -1] / self.scale
        self.yy = c[-1, -1]

    def model(self, beta: np.ndarray) -> dict[str, float]:
        """Active weights by feature, on the features' own scale, and ``bias``."""
        b = beta / self.scale
        return {n: float(x) for n, x in zip(self.names, b) if x} | {"bias": float(self.y_mean - b @ self.mean)}


def elastic_net(m: Moments, alpha: float = 0.1, l1_ratio: float = 0.5, sweeps: int = 500, tolerance: float = 1e-9) -> dict[str, float]:
    """Coordinate descent."""
    beta = np.zeros(len(m.names))
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(beta)):
            r = m.xy[j] - m.gram[j] @ beta + m.gram[j, j] * beta[j]
            new = np.sign(r) * max(abs(r) - alpha * l1_ratio, 0) / (m.gram[j, j] + alpha * (1 - l1_ratio) or 1)
            most, beta[j] = max(most, abs(new - beta[j])), new
        if most < tolerance:
            break
    return m.model(beta)


def forward_selection(m: Moments, k: int) -> dict[str, float]:
    """The k features chosen by the greatest correlation with what is left, refitted each time."""
    active, beta = [], np.zeros(len(m.names))
    for _ in range(min(k, len(beta))):
        left = np.abs(m.xy - m.gram @ beta)
        left[active] = -1
        active.append(int(left.argmax()))
        beta = np.zeros(len(m.names))
        beta[active] = np.linalg.lstsq(m.gram[np.ix_(active, active)], m.xy[active], rcond=None)[0]
    return m.model(beta)


def lars(m: Moments, k: int | None = None, lasso: bool = False) -> dict[str, float]:
    """Least-angle steps until k features are active (all by default); lasso: a feature whose weight reaches 0 drops out."""
    p, beta, active = len(m.names), np.zeros(len(m.names)), []
    k = p if k is None else min(k, p)
    dropped = None
    for _ in range(8 * p):
        c = m.xy - m.gram @ beta
        top = np.abs(c).max()
        if top < 1e-10 or len(active) >= k and not lasso and len(active) == k == 0:
            break
        if dropped is None:
            free = [j for j in range(p) if j not in active]
            if free and len(active) < k:
                active.append(max(free, key=lambda j: (abs(c[j]), -j)))
        dropped = None
        s = np.sign(c[active])
        g = np.linalg.pinv(m.gram[np.ix_(active, active)] * np.outer(s, s))
        a = 1 / np.sqrt(max(g.sum(), 1e-300))
        direction = np.zeros(p)
        direction[active] = a * g.sum(axis=1) * s
        slope = m.gram @ direction
        step = top / a
        for j in range(p):
            if j not in active:
                for x in ((top - c[j]) / (a - slope[j]) if a != slope[j] else np.inf, (top + c[j]) / (a + slope[j]) if a != -slope[j] else np.inf):
                    if 1e-12 < x < step:
                        step = x
        if lasso:
            for j in active:
                if direction[j] and 1e-12 < (x := -beta[j] / direction[j]) < step:
                    step, dropped = x, j
        beta = beta + step * direction
        if dropped is not None:
            beta[dropped] = 0.0
            active.remove(dropped)
        elif len(active) == k:
            break
    return m.model(beta)


def explain(predict, example: dict[str, float], spread: dict[str, float], spark, n: int = 500, k: int = 5, width: float = 0.75, seed: int = 1) -> dict[str, float]:
    """A local explanation: perturbed copies of an example, weighted by nearness, and the k features of a sparse linear fit to the predictions.

    predict: function of a table with the example's columns that adds ``y``.
    """
    from skarn.sources.synthetic import gaussian

    names = sorted(example)
    rows = spark.range(n).select("id", *[(F.lit(float(example[c])) + float(spread[c]) * gaussian(seed, i)).alias(c) for i, c in enumerate(names)])
    far = sum(((F.col(f"`{c}`") - float(example[c])) / (float(spread[c]) or 1.0)) ** 2 for c in names)
    near = rows.withColumn("near", F.exp(-far / (width * width * len(names))))
    return forward_selection(Moments(predict(near), names, "y", "near"), k)
