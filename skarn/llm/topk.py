"""Exact top-k inner products by pivot-table elimination.

With all vectors as points, <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2, and for
every pivot p, d(q, x) >= |d(q, p) - d(x, p)|.  The largest of these lower
bounds over the pivots bounds each score from above.  The pivots are fitted once, and the distances
of all rows to them written as a table.  The rows of the pivots' sample are scored first, so
that the search starts from a score that k rows reach; then candidates are scored in
the order of their bounds, until the next bound is below the k-th score.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import shared_dir, written

#: Queries that are broadcast at a time, and rows that are bounded at a time.
QUERIES_AT_ONCE, ROW_PART = 32_768, 4096
#: Rows of the sample (half of them the longest vectors) from which pivots and first scores come: a bound on what the driver holds.
SAMPLE = 1024
#: The largest score of 64 bits; scores are ranked up to 38 digits.
LONG, DIGITS = (1 << 63) - 1, 10**38 - 1


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles if all are below 2**53, else Python's whole numbers."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if not y.size or np.abs(y).max() < 1 << 53:
        return y
    out = np.empty(y.size, object)
    out[:] = [int(a) if math.isfinite(a) else int(b) * scale for a, b in zip(y.ravel().tolist(), x.ravel().tolist())]
    return out.reshape(y.shape)


def dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles, 64-bit integers or Python's, whichever is sure to hold them."""
    if not x.size or not q.size:
        return np.zeros(x.shape[:1] + q.shape[1:], np.int64)
    most = int(np.abs(x).max()) * int(np.abs(q).max()) * x.shape[1]
    if most < 1 << 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    kind = np.int64 if most <= LONG else object
    return _ints(x, kind) @ _ints(q, kind)


def _ints(x: np.ndarray, kind) -> np.ndarray:
    return x.astype(np.int64).astype(kind) if x.dtype != object else x.astype(kind)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample far from each other: first the longest vector, then always the farthest from those chosen."""
    with np.errstate(over="ignore", invalid="ignore"):
        chosen = [int(np.nan_to_num(np.linalg.norm(sample, axis=1)).argmax())]
        far = np.nan_to_num(np.linalg.norm(sample - sample[chosen[0]], axis=1))
        while len(chosen) < min(n, len(sample)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.nan_to_num(np.linalg.norm(sample - sample[chosen[-1]], axis=1)))
    return sample[chosen]


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, in doubles; the norms come in the last column."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.column_stack([*[np.linalg.norm(x - one, axis=1) for one in p], np.linalg.norm(x, axis=1)])


def _by_length(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the lists of each length."""
    flat, at = column.flatten().to_numpy(), column.offsets.to_numpy()
    at = at - at[0]
    lens = np.diff(at)
    return [(rows, flat[at[rows][:, None] + np.arange(n)]) for n in np.unique(lens).tolist() for rows in [np.flatnonzero(lens == n)]]


class Queries:
    """Queries of one length, with their distances to the pivots and the scores that k rows are known to reach."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, pivots: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int, scale: int):
        self.ids, self.whole = ids, whole(vecs, scale)
        self.table = distances(self.whole.astype(np.float64), pivots)
        scores = dots(self.whole, whole(sample, scale).T)
        self.least = []
        for i, row in zip(ids.tolist(), scores):
            others = np.sort(row[sample_ids != i])
            self.least.append(max(-DIGITS, min(DIGITS, int(others[-k]))) if len(others) >= k else None)


def eliminate(q: Queries, x_ids: np.ndarray, x: np.ndarray, table: np.ndarray, k: int):
    """For each query (its number, rows that may be among its k best, their scores, number of rows scored), by the pivots' table of the rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms, to_pivots = table[:, -1], np.ascontiguousarray(table[:, :-1].T)
        for i in range(len(q.ids)):
            own, qn = q.table[i, :-1], q.table[i, -1]
            low = np.zeros(len(x))
            for to, d in zip(to_pivots, own):
                np.maximum(low, np.abs(to - d) - 1e-9 * (to + d), out=low)  # less than the roots' rounding can make of it
            bound = (qn * qn + norms * norms - low * low) / 2
            bound = np.minimum(bound, qn * norms) + 1e-9 * (qn * qn + norms * norms) + 0.5
            bound[np.isnan(bound)] = np.inf
            least = q.least[i]
            go = np.flatnonzero((bound >= float(least)) if least is not None else np.full(len(x), True))
            go = go[x_ids[go] != q.ids[i]]
            go = go[np.argsort(-bound[go], kind="stable")]
            best_ids, best, scored = np.empty(0, np.int64), np.empty(0, object), 0
            for a in range(0, len(go), 256):
                some = go[a : a + 256]
                if len(best) == k and bound[some[0]] < float(best[-1]):
                    break  # every other bound is lower still
                scored += len(some)
                best_ids, best = np.concatenate([best_ids, x_ids[some]]), np.concatenate([best, np.clip(dots(x[some], q.whole[i]).astype(object), -DIGITS, DIGITS)])
                keep = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[keep], best[keep]
            yield i, best_ids.tolist(), best.tolist(), scored


def top_k(
    vectors: DataFrame,
    query_ids,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    pivots: int = 24,
    stats: bool = False,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest integer inner products, ties to the smaller vec_id.

    Components become floor(scale * x).  query_ids: function of the id column
    that tells which rows are queries; a query's own id is never its candidate.
    Vectors that are null or empty, hold null or non-finite components, or have a null id take no part;
    vectors of other lengths than the query's aren't its candidates.  Repeated
    rows of one id stay candidates, and queries, row by row; a repeated query has one ranking.  Scores are exact whatever the
    components' size; one beyond 64 bits is ranked as it is (up to 38 digits) and shown as the nearest number of 64 bits.
    stats: adds n_scored, the rows that were scored for the query; all others were eliminated.

    Queries are broadcast QUERIES_AT_ONCE at a time, a pass over the pivot table each; no row is shuffled, nor is
    any copied for a block of queries.  Each part of the table keeps k rows a query, and a window ranks what is left.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    ok = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(ok & (F.size("vec") > 0))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c)
    sample = rows.orderBy(norm.desc(), "vec_id").limit(SAMPLE // 2).collect() + rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE // 2).collect()
    held: dict[int, dict] = {}
    for r in sample:  # a row that both halves hold counts once
        held.setdefault(len(r.vec), {})[r.vec_id, tuple(r.vec)] = None
    samples = {n: (np.array([i for i, _ in d], np.int64), np.array([v for _, v in d])) for n, d in held.items()}
    chosen = {n: choose_pivots(whole(v, scale).astype(np.float64), pivots) for n, (_, v) in samples.items()}

    def tabled(batches):
        for b in batches:
            table = [None] * b.num_rows
            for at, x in _by_length(b.column("vec")):
                y = whole(x, scale).astype(np.float64)
                for i, d in zip(at.tolist(), distances(y, chosen.get(x.shape[1], np.empty((0, x.shape[1]))))):
                    table[i] = d
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), pa.array(table, pa.list_(pa.float64()))], names=["vec_id", "vec", "pivots"])

    table = written(rows.mapInArrow(tabled, "vec_id long, vec array<double>, pivots array<double>"), "pivots")
    queries = table.where(query_ids(F.col("vec_id"))).select("vec_id", "vec").distinct()
    n_passes = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    kind = "query_id long, vec_id long, exact decimal(38,0), n_scored long"

    def searched(nth: int) -> DataFrame:
        some: dict[int, list] = {}
        for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_passes)) == nth).orderBy("vec_id").collect():
            some.setdefault(len(r.vec), []).append(r)
        none = (np.empty(0, np.int64), None)
        made = {}
        for n, rs in some.items():
            ids, vecs = samples.get(n, none)
            vecs = np.empty((0, n)) if vecs is None else vecs
            made[n] = Queries(np.array([r.vec_id for r in rs], np.int64), np.array([r.vec for r in rs]), chosen.get(n, np.empty((0, n))), ids, vecs, k, scale)
        sent = spark.sparkContext.broadcast(made)

        def best(batches):
            for b in batches:
                for a in range(0, b.num_rows, ROW_PART):
                    part = b.slice(a, ROW_PART)
                    ids, out = part.column("vec_id").to_numpy(), [[], [], [], []]
                    for at, x in _by_length(part.column("vec")):
                        q = sent.value.get(x.shape[1])
                        if q is None:
                            continue
                        column = part.column("pivots").take(pa.array(at))
                        d = column.flatten().to_numpy().reshape(len(at), -1)
                        for i, found, scores, scored in eliminate(q, ids[at], whole(x, scale), d, k):
                            n = max(1, len(found))
                            out[0] += [int(q.ids[i])] * n
                            out[1] += found or [None]
                            out[2] += [Decimal(int(s)) for s in scores] or [None]
                            out[3] += [scored] + [0] * (n - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64()))], names=["query_id", "vec_id", "exact", "n_scored"])

        return table.mapInArrow(best, kind)

    if n_passes == 1:
        found = searched(0)
    else:
        found = written(searched(0), "found")
        for nth in range(1, n_passes):
            found = found.unionByName(written(searched(nth), "found"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id"))
    score = F.greatest(F.least("exact", F.lit(LONG)), F.lit(-LONG)).cast("long")
    out = found.where("vec_id IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
    return out.join(found.groupBy("query_id").agg(F.sum("n_scored").alias("n_scored")), "query_id") if stats else out
