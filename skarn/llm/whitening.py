"""Whitening of vectors: moments by Welford's rank-one updates, eigenvectors by the symmetric QR algorithm.

Each task streams its rows and keeps a count, exact sums, a mean and the matrix of squared deviations from it, changed by one
outer product a row (Welford, 1962); tasks are merged by the parallel update formula (Chan et al., 1979), FOLDS ways on
executors and then on the driver.  Nothing is ever summed before it is centred, so values of a million with deviations of ten
keep their digits.  The driver solves one matrix: Householder's tridiagonal form, then implicit QR steps with Wilkinson's shift.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import folded

#: Longest vectors: the driver and every task hold a matrix of their length squared.
MAX_DIM = 4096
#: Vectors of more lengths than this in one table are an error: each has moments of its own.
MAX_LENGTHS = 64
LONG = (1 << 63) - 1
#: Eigenvalues below this share of the trace are taken for zero; such components are left out.
FLAT = 1e-12


@dataclass
class Moments:
    """Rows, exact sums, mean, and the sum of (x - mean)(x - mean)'."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def nothing(cls, d: int) -> Moments:
        return cls(0, [0] * d, np.zeros(d), np.zeros((d, d)))

    def add(self, x: np.ndarray) -> None:
        """One row: a rank-one update."""
        self.n += 1
        delta = x - self.mean
        self.mean += delta / self.n
        self.scatter += np.multiply.outer(delta, x - self.mean)

    def merge(self, other: Moments) -> Moments:
        """Both sets of rows, by the parallel update formula."""
        n = self.n + other.n
        if not n:
            return self
        delta = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.multiply.outer(delta, delta) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], self.mean + delta * (other.n / n), scatter)

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)

    #: Whole numbers travel as parts of 30 bits, so that doubles carry them exactly.
    PARTS = 8

    def vector(self) -> np.ndarray:
        whole = [_parts(self.n), *[_parts(s) for s in self.sums]]
        return np.concatenate([np.array(whole, float).ravel(), self.mean, self.scatter.ravel()])

    @classmethod
    def of(cls, v: np.ndarray, d: int) -> Moments:
        p = cls.PARTS * (d + 1)
        n, *sums = [sum(int(a) << (30 * i) for i, a in enumerate(row)) for row in v[:p].reshape(d + 1, -1)]
        return cls(n, sums, v[p : p + d].copy(), v[p + d :].reshape(d, d).copy())


def _parts(x: int) -> list[int]:
    sign, x = (-1 if x < 0 else 1), abs(x)
    return [sign * (x >> (30 * i) & ((1 << 30) - 1)) for i in range(Moments.PARTS)]


def _moments(rows: DataFrame, matrices, d: int, shift: int = 0) -> Moments:
    """The moments of the matrices that ``matrices`` makes of each Arrow batch: whole numbers (exact sums) or doubles.

    The mean is that of x - shift: near zero, where doubles are dense; covariances don't know of it.
    """

    def partial(batches):
        m = Moments.nothing(d)
        for b in batches:
            x = matrices(b)
            if x.dtype == np.int64 and len(x):
                m.sums = [a + s for a, s in zip(m.sums, _exact_sums(x))]
            for row in (x - shift).astype(np.float64):
                m.add(row)
        if m.n:
            yield m.vector()

    return Moments.of(folded(rows, partial, lambda a, b: Moments.of(a, d).merge(Moments.of(b, d)).vector(), Moments.nothing(d).vector()), d)


def _exact_sums(x: np.ndarray) -> list[int]:
    if int(np.abs(x).max(initial=0)) <= LONG // len(x):
        return x.sum(axis=0).tolist()
    return [int(s) for s in x.astype(object).sum(axis=0)]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, subdiagonal, q) with q' a q tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if not size or not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors in columns) of a symmetric matrix; each vector's largest entry is positive."""
    n = len(a)
    d, e, q = tridiagonal((a + a.T) / 2)
    qt, eps = np.ascontiguousarray(q.T), np.finfo(float).eps
    hi = n - 1
    for _ in range(60 * max(n, 1)):
        while hi > 0 and abs(e[hi - 1]) <= eps * (abs(d[hi - 1]) + abs(d[hi])):
            e[hi - 1] = 0.0
            hi -= 1
        if hi <= 0:
            break
        lo = hi - 1
        while lo > 0 and abs(e[lo - 1]) > eps * (abs(d[lo - 1]) + abs(d[lo])):
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2  # Wilkinson's shift: the eigenvalue of the last 2 x 2 block nearer to its corner
        shift = d[hi] - e[hi - 1] ** 2 / (half + (np.copysign(np.hypot(half, e[hi - 1]), half) or 1.0))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            qt[k : k + 2] = np.array([[c, s], [-s, c]]) @ qt[k : k + 2]
    order = np.argsort(-d, kind="stable")
    vectors = qt[order].T
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)]) if n else np.ones(0)
    return d[order], vectors * signs


@dataclass
class Whitening:
    """What whitens vectors of one length: moments of the fit list, the kept eigenvalues (falling) and eigenvectors, each one's share of the trace, and how far the whitened covariance is from the identity."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from the exact whole number n x - S."""
        n, s = self.moments.n, self.moments.sums
        if (int(np.abs(x).max(initial=0)) * n + max(map(abs, s), default=0)) <= LONG:
            return (x * n - np.array(s, np.int64)) / n
        return ((x.astype(object) * n - np.array(s, object)) / n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2, exact; beyond 64 bits the largest number of 64 bits."""
        n, s = self.moments.n, self.moments.sums
        most = int(np.abs(x).max(initial=0)) * n + max(map(abs, s), default=0)
        if most * most * max(1, x.shape[1]) <= LONG:
            return ((x * n - np.array(s, np.int64)) ** 2).sum(axis=1).tolist()
        deviations = x.astype(object) * n - np.array([int(a) for a in s], object)
        return [min(LONG, int(v)) for v in (deviations * deviations).sum(axis=1)]


def _integers(column, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset as 64-bit integers; beyond them the nearest they have."""
    flat = column.flatten().to_numpy().astype(np.float64)
    with np.errstate(over="ignore"):
        y = np.floor(scale * flat)
    room = float(1 << 62)
    return np.where(np.abs(y) < room, np.where(np.abs(y) < room, y, 0).astype(np.int64) + offset, np.where(y > 0, LONG, -LONG)).reshape(len(column), -1)


def fit(vectors: DataFrame, length: int, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitening:
    """The whitening of the rows (column v, of one length), and a second pass that measures it."""
    m = _moments(vectors, lambda b: _integers(b.column("v"), scale, offset), length, offset)
    values, basis = symmetric_qr(m.covariance())
    trace = float(np.trace(m.covariance()))
    kept = [i for i in range(min(components, length)) if values[i] > FLAT * trace]
    made = Whitening(m, values[kept], basis[:, kept], values[kept] / trace if trace else values[kept])
    if kept:
        again = _moments(vectors, lambda b: made.whitened(_integers(b.column("v"), scale, offset)), len(kept))
        made.identity_error = float(np.abs(again.covariance() - np.eye(len(kept))).max())
    return made


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Entries c become the whole number floor(scale * c) + offset.  Vectors that are null or empty or hold null or non-finite entries
    are dropped; null and repeated ids, and repeated rows, stay.  Vectors of different lengths have moments,
    components and an ``n`` of their own.  Components without variance (all rows alike, or fewer rows than
    dimensions) have no rows.  Of a deviation beyond 64 bits the largest number of 64 bits is given.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))))
    lengths = sorted(r.d for r in rows.select(F.size("v").alias("d")).distinct().limit(MAX_LENGTHS + 1).collect())
    if len(lengths) > MAX_LENGTHS or max(lengths, default=0) > MAX_DIM:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths, or longer than {MAX_DIM}")
    made = {d: fit(rows.where(F.size("v") == d) if len(lengths) > 1 else rows, d, components, scale, offset) for d in lengths}

    def run(batches):
        for b in batches:
            sizes = np.diff(b.column("v").offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                w = made[d]
                k = len(w.values)
                for a in range(0, len(at) if k else 0, 256):
                    part = b.take(pa.array(at[a : a + 256]))
                    x = _integers(part.column("v"), scale, offset)
                    r = len(x)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("vec_id").take(pa.array(np.repeat(np.arange(r), k))),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                            pa.array(np.full(r * k, w.moments.n)),
                            pa.array(np.repeat(np.array(w.deviation(x), np.int64), k)),
                            pa.array(w.whitened(x).ravel()),
                            pa.array(np.tile(w.explained, r)),
                            pa.array(np.full(r * k, w.identity_error)),
                        ],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
