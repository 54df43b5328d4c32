"""Gaussian mixtures by expectation-maximisation, with full, diagonal or spherical covariances.

A round is one pass: each task adds up, for each component, the responsibilities and the first and second moments around the component's
present mean; these are summed by place and the driver makes the next components of them (components x width squared numbers).
Densities are taken in logarithms, so far points and narrow components neither vanish nor overflow.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.linear import matrix

KINDS = ("full", "diagonal", "spherical")
#: Numbers of all components together that the driver holds.
MOST_NUMBERS = 20_000_000


@dataclass
class Mixture:
    """Shares, means (a row each) and covariances: matrices (full), rows of variances (diagonal) or one variance each (spherical); the mean log-likelihood before each round."""

    shares: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    kind: str
    likelihoods: list[float] = field(default_factory=list)

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """ln(share x density) of each row under each component."""
        out, d = np.empty((len(x), len(self.means))), x.shape[1]
        for j, (mean, cov) in enumerate(zip(self.means, self.covariances)):
            e = x - mean
            if self.kind == "full":
                root = np.linalg.cholesky(cov)
                z = np.linalg.solve(root, e.T)
                out[:, j] = -(z * z).sum(axis=0) / 2 - np.log(np.diag(root)).sum()
            else:
                v = np.broadcast_to(cov, d)
                out[:, j] = -(e * e / v).sum(axis=1) / 2 - np.log(v).sum() / 2
        with np.errstate(divide="ignore"):
            return out - d * np.log(2 * np.pi) / 2 + np.log(self.shares)

    def predict(self, df: DataFrame, id_col: str, vector: str) -> DataFrame:
        """(id, cluster, responsibilities, log_density): the component most likely to have made each vector, ties to the first; null vectors go."""
        rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        kind = rows.schema["id"].dataType.simpleString()

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                z = self.log_densities(matrix(b, "v"))
                whole = np.logaddexp.reduce(z, axis=1)
                r = np.exp(z - whole[:, None])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, r.size + 1, r.shape[1], dtype=np.int32)), pa.array(r.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(z.argmax(axis=1).astype(np.int32)), lists, pa.array(whole)], names=["id", "cluster", "responsibilities", "log_density"])

        return rows.mapInArrow(run, f"id {kind}, cluster int, responsibilities array<double>, log_density double")


def spread_means(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """k-means++: each next mean is a row drawn with a chance in proportion to its squared distance to those before, one pass each.  rows: (key, v)."""
    u = lambda n: (F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "key"), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    chosen: list[list[float]] = []
    while len(chosen) < k:
        if chosen:
            far = lambda c: F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
            weight = F.least(*[far(c) for c in chosen]) if len(chosen) > 1 else far(chosen[0])
        else:
            weight = F.lit(1.0)
        first = rows.withColumn("w", weight).where("w > 0").orderBy(F.desc(F.ln(u(len(chosen))) / F.col("w")), "key").limit(1).collect()
        if not first:
            break
        chosen.append([float(x) for x in first[0].v])
    return np.array(chosen)


def fit(df: DataFrame, vector: str, k: int, kind: str = "diagonal", rounds: int = 30, least_gain: float = 1e-3, jitter: float = 1e-6, seed: int = 1, key: str | None = None, means: np.ndarray | None = None) -> Mixture:
    """A mixture of up to ``k`` components (fewer if there are fewer distinct vectors).

    means: where they start; else by k-means++, for which ``key`` tells rows apart.  Shares start equal, variances at one.
    jitter is added to all variances.  Rounds end when the mean log-likelihood gains less than ``least_gain``, the most being ``rounds``.
    A component that no row answers for stays as it is.  Null vectors take no part; no vectors are an error.
    """
    if kind not in KINDS:
        raise ValueError(kind)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), (F.col(key) if key else F.lit(None)).alias("key"))
    if means is None:
        if key is None:
            raise ValueError("k-means++ needs a key")
        means = spread_means(rows, k, seed)
    if not len(means):
        raise ValueError("no rows to learn from")
    k, d = means.shape
    second = d * d if kind == "full" else d
    if k * (1 + d + second) > MOST_NUMBERS:
        raise ValueError(f"{k} components of {d} dimensions are beyond the bound of {MOST_NUMBERS} numbers")
    start = {"full": np.broadcast_to(np.eye(d), (k, d, d)), "diagonal": np.ones((k, d)), "spherical": np.ones(k)}[kind]
    made = Mixture(np.full(k, 1 / k), means.astype(float), start.copy(), kind)
    vectors = rows.select("v")
    for _ in range(rounds):

        def run(batches, now=made):
            count, first, squares, total, n = np.zeros(k), np.zeros((k, d)), np.zeros((k, second)), 0.0, 0
            for b in batches:
                x = matrix(b, "v") if b.num_rows else np.empty((0, d))
                for a in range(0, len(x), 1024):
                    part = x[a : a + 1024]
                    z = now.log_densities(part)
                    whole = np.logaddexp.reduce(z, axis=1)
                    r = np.exp(z - whole[:, None])
                    total, n, count = total + whole.sum(), n + len(part), count + r.sum(axis=0)
                    for j in range(k):
                        e = part - now.means[j]
                        first[j] += r[:, j] @ e
                        squares[j] += ((e * r[:, [j]]).T @ e).ravel() if now.kind == "full" else r[:, j] @ (e * e)
            if n:
                flat = np.concatenate([[total, n], count, first.ravel(), squares.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "x"])

        sums = np.zeros(2 + k * (1 + d + second))
        for r in vectors.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toLocalIterator():
            sums[r.i] = r.x
        if not sums[1]:
            raise ValueError("no rows to learn from")
        count, first, squares = sums[2 : 2 + k], sums[2 + k : 2 + k + k * d].reshape(k, d), sums[2 + k + k * d :].reshape(k, second)
        likelihoods = [*made.likelihoods, float(sums[0] / sums[1])]
        means, covariances = made.means.copy(), made.covariances.copy()
        for j in np.flatnonzero(count > 1e-9):
            move = first[j] / count[j]
            means[j] = made.means[j] + move
            if kind == "full":
                covariances[j] = squares[j].reshape(d, d) / count[j] - np.outer(move, move) + jitter * np.eye(d)
            else:
                v = np.maximum(squares[j] / count[j] - move * move, 0) + jitter
                covariances[j] = v if kind == "diagonal" else v.mean()
        made = Mixture(count / sums[1], means, covariances, kind, likelihoods)
        if len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < least_gain:
            break
    return made
