"""Centroid clustering by annulus search (Hamerly and Drake, 2015), in whole numbers.

A centroid that is nearer to a vector than r has a norm within r of the vector's own.  So centroids are sorted by norm, the distance to
the centroid that the vector had before is an upper bound, and a binary search finds the centroids whose norms lie in that
annulus; only these are compared, exactly, those on its edge too.  Each round writes a table: every vector with its centroid, and
from each task the counts and sums of its centroids, so one pass assigns and adds up, and a lost executor repeats its share of one round.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import release, shared_dir, written
from skarn.llm.topk import LONG, whole

#: Vectors that are compared at a time.
PART = 2048
#: Sums of whole numbers are kept up to 38 digits.
DIGITS = 10**38 - 1


@dataclass
class Centroids:
    """Whole-number centroids in their own order, and sorted by norm."""

    rows: np.ndarray  # k x d, doubles below 2**53 or Python's whole numbers

    def __post_init__(self) -> None:
        self.norms = np.sqrt((self.rows.astype(float) ** 2).sum(axis=1))
        self.order = np.argsort(self.norms, kind="stable")
        self.sorted = self.norms[self.order]

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the nearest centroid, ties to the smaller; squared distance; how many distances were computed).  before: any centroid's number, best the last one.

        The annulus is a little wider than its bound, by more than the roots' rounding.
        """
        x, c = _alike(x, self.rows)
        best, number = _squares(x, c[before]), before.copy()
        with np.errstate(over="ignore", invalid="ignore"):
            norm, radius = np.sqrt((x.astype(float) ** 2).sum(axis=1)), np.sqrt(best.astype(float))
            slack = 1e-9 * (norm + radius + self.sorted[-1]) + 1e-9
            low = np.searchsorted(self.sorted, np.nan_to_num(norm - radius - slack, nan=0.0), "left")
            high = np.searchsorted(self.sorted, np.nan_to_num(norm + radius + slack, nan=np.inf), "right")
        done = np.ones(len(x), np.int64)
        for step in range(int((high - low).max(initial=0))):
            at = np.flatnonzero(low + step < high)
            other = self.order[low[at] + step]
            at, other = at[other != before[at]], other[other != before[at]]
            d = _squares(x[at], c[other])
            done[at] += 1
            better = (d < best[at]) | ((d == best[at]) & (other < number[at]))
            best[at[better]], number[at[better]] = d[better], other[better]
        return number, best, done


def _alike(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers where squared distances are sure to fit, else as Python's whole numbers."""
    most = max((int(np.abs(m).max()) for m in (x, c) if m.size), default=0)
    kind = np.int64 if 4 * most * most * max(1, x.shape[1]) <= LONG else object
    return tuple(m.astype(kind) if kind is np.int64 else _objects(m) for m in (x, c))


def _objects(m: np.ndarray) -> np.ndarray:
    return m if m.dtype == object else m.astype(np.int64).astype(object)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=1)


def _starts(rows: DataFrame, k: int, salt: str, scale: int) -> np.ndarray:
    """The k vectors whose ids hash smallest, in the order of the hashes; null ids come last, equal ids by the vector."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), F.col("v").cast("array<double>").alias("v")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return whole(np.array([r.v for r in first], float), scale) if first else np.empty((0, 0))


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dim: int = 64,
    scale: int = 1024,
    salt: str = "3:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, n_compared: a row for each vector of exactly ``dim`` components.

    Components become floor(scale * x).  Centroids start as the ``k`` vectors whose ``salt`` and id hash smallest (sha-256); each round assigns all
    vectors (ties to the smaller number) and moves every centroid that has some to floor(sum / count); after the rounds all are assigned once more.
    Vectors that are null, of another length or hold null or non-finite components take no part.  Rows with a null id do,
    and start a centroid only if too few have one; repeated rows count as often as they come, and of equal ids the smaller vector comes first.
    Fewer vectors than ``k`` make fewer centroids, none an empty result.  Whole numbers are exact at any size; a distance or an inertia
    beyond 64 bits is shown as the largest number of 64 bits.  n_compared: the distances that were computed for the vector in the last pass, the bound's included.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))))
    kind = "float" if rows.schema["v"].dataType.simpleString() == "array<float>" else "double"
    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    centroids = _starts(rows, k, salt, scale)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_compared int")
    shape = {"vec_id": pa.int64(), "v": pa.list_(pa.float32() if kind == "float" else pa.float64()), "cluster": pa.int32(), "distance": pa.int64(), "n_compared": pa.int32(), "count": pa.int64(), "sums": pa.list_(pa.decimal128(38, 0)), "total": pa.decimal128(38, 0)}
    ddl = f"vec_id long, v array<{kind}>, cluster int, distance long, n_compared int, count long, sums array<decimal(38,0)>, total decimal(38,0)"

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if columns.get(c) is None else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t) for c, t in shape.items()], names=list(shape))

    def assigned(table: DataFrame, centroids: np.ndarray, last: bool) -> DataFrame:
        """Every vector with its centroid and, from each task, a row for each of its centroids: count and sums, at last the summed distance."""

        def run(batches):
            own = Centroids(centroids)
            count, total = [0] * len(centroids), [0] * len(centroids)
            sums = np.zeros((len(centroids), dim), object)
            for b in batches:
                for a in range(0, b.num_rows, PART):
                    part = b.slice(a, PART)
                    x = whole(part.column("v").flatten().to_numpy().astype(np.float64).reshape(-1, dim), scale)
                    number, d, done = own.nearest(x, part.column("cluster").to_numpy())
                    for j in np.unique(number).tolist():
                        some = number == j
                        count[j] += int(some.sum())
                        if last:
                            total[j] += sum(d[some].tolist())
                        else:
                            sums[j] += _column_sums(x[some])
                    n = len(x)
                    yield batch(n, vec_id=part.column("vec_id"), v=None if last else part.column("v"), cluster=number.astype(np.int32), distance=[min(LONG, v) for v in d.tolist()], n_compared=done.astype(np.int32))
            at = [j for j, n in enumerate(count) if n]
            decimals = [[Decimal(max(-DIGITS, min(DIGITS, int(s)))) for s in sums[j]] for j in at]
            yield batch(len(at), cluster=at, count=[count[j] for j in at], sums=decimals, total=[Decimal(min(DIGITS, total[j])) for j in at])

        return written(table.mapInArrow(run, ddl), "assigned")

    table = rows.select("vec_id", "v", F.lit(0).alias("cluster"))
    held = None
    for nth in range(rounds + 1):
        made = assigned(table, centroids, nth == rounds)
        if held is not None:
            release(held)
        held, table = made, made.where("count IS NULL").select("vec_id", "v", "cluster")
        if nth < rounds:
            moved = made.where("count IS NOT NULL").select("cluster", "count", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("count").alias("n"))
            centroids = centroids.astype(object)
            for r in moved.collect():  # a number for each centroid and dimension
                centroids[r.cluster, r.i] = int(r.s) // r.n
            centroids = _narrow(centroids)
    totals = {r.cluster: int(r.t) for r in held.where("count IS NOT NULL").groupBy("cluster").agg(F.sum("total").alias("t")).collect()}
    told = [(j, min(LONG, totals.get(j, 0)), min(LONG, sum(totals.values())), hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()) for j, row in enumerate(centroids.tolist())]
    of = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    shown = held.where("count IS NULL").select("vec_id", "cluster", "distance", "n_compared").join(F.broadcast(of), "cluster")  # k rows
    return shown.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_compared")


def _column_sums(x: np.ndarray) -> np.ndarray:
    if x.dtype != object and (not x.size or float(np.abs(x).max()) * len(x) < 1 << 53):
        return np.array([int(v) for v in x.sum(axis=0)], object)
    return _objects(x).sum(axis=0)


def _narrow(c: np.ndarray) -> np.ndarray:
    """Doubles where all are below 2**53."""
    return c.astype(float) if max((abs(int(v)) for v in c.ravel()), default=0) < 1 << 53 else c
