"""Exact kernel machines: a table of dual weights over support rows, grown block by block, equal to an online pass over single rows.

A row is learnt from when, with one taken off its own label's score, another label scores best (or as well and comes first): its weight is then added to its dual weight.
Rows come in a shuffled order, cut into blocks.  A block's scores against all support rows are sums over these where they lie, in all tasks; within the block one task
goes on row by row with the kernel values of the block alone, and writes the rows that it has learnt from.  So the result doesn't depend on the size of the blocks, but for the rounding
of sums (not at all where kernel values are whole numbers).  Driver and tasks hold a block (``block`` rows) or a part of the support rows (``PART`` bytes), never all of either.

A pass takes as many kernel values as rows times support rows, which is the method's price; ``kernel.fit`` with its landmarks has none of it.  Linear kernels and polynomial ones of a
whole degree are sums over few monomials (``Monomials``): there the support rows' part in all scores is a table of a weight for each monomial and output, and a pass takes time in proportion to the
rows.  It is taken where support rows can outnumber the monomials.  Rows are learnt from in the same order with the same scores, but for the rounding of sums (none for whole numbers).
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations_with_replacement
from math import comb, factorial, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.kernel import KERNELS
from skarn.operators.sampling import position
from skarn.operators.scratch import Scratch

#: Bytes of support rows that a pass of the prediction sends to the tasks.
PART = 64 << 20
#: Rows and support rows whose kernel values are in memory at a time.
ROWS, SUPPORT = 1024, 4096
#: Tables of newly learnt rows before they become one.
TABLES = 32
#: Weights of monomials at most; blocks of rows that a task learns from, one after the other, before it hands the weights on.
MOST_WEIGHTS, CHAIN = 1 << 18, 64


class Monomials:
    """A kernel as a sum over monomials: k(x, y) = sum of factors * of(x) * of(y)."""

    def __init__(self, width: int, degree: int, gamma: float, coefficient: float):
        made = []
        for at in combinations_with_replacement(range(width + 1), degree):  # the last place stands for a one
            factor = factorial(degree) / prod(map(factorial, Counter(at).values())) * gamma ** sum(i < width for i in at) * coefficient ** at.count(width)
            if factor:
                made.append((at, factor))
        self.at, self.factors = np.array([a for a, _ in made]).reshape(len(made), degree), np.array([f for _, f in made])

    @classmethod
    def find(cls, kernel: str, width: int, outputs: int, rows: int, options: dict) -> Monomials | None:
        """Those of the kernel, if it has few and ``rows`` outnumber them (and what is compared at a time)."""
        degree, gamma, coefficient = {"linear": (1, 1.0, 0.0), "polynomial": (options.get("degree", 2), options.get("gamma", 1.0), options.get("coefficient", 1.0))}.get(kernel, (0, 0, 0))
        if int(degree) != degree or degree < 1 or comb(width + int(degree), int(degree)) * outputs > MOST_WEIGHTS or rows <= max(SUPPORT, comb(width + int(degree), int(degree))):
            return None
        return cls(width, int(degree), gamma, coefficient)

    def of(self, x: np.ndarray) -> np.ndarray:
        whole = np.column_stack([x, np.ones(len(x))])
        out = whole[:, self.at[:, 0]]
        for place in range(1, self.at.shape[1]):
            out *= whole[:, self.at[:, place]]
        return out

    def weights(self, x: np.ndarray, y: np.ndarray, alpha: np.ndarray, outputs: int) -> np.ndarray:
        """The part of support rows in the weights, by monomial and output."""
        out = np.zeros((len(self.at), outputs))
        for i in range(0, len(x), ROWS):
            duals = np.zeros((len(x[i : i + ROWS]), outputs))
            duals[np.arange(len(duals)), y[i : i + ROWS]] = alpha[i : i + ROWS]
            out += self.of(x[i : i + ROWS]).T @ duals
        return out

    def scores(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        weighted = self.factors[:, None] * weights
        return np.concatenate([self.of(x[i : i + ROWS]) @ weighted for i in range(0, len(x), ROWS)] or [np.empty((0, weights.shape[1]))])


def _flat(column, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, flat = len(values), values.flatten().to_numpy(zero_copy_only=False)
    if n and (len(flat) != n * width or set(values.value_lengths().to_pylist()) != {width}):
        raise ValueError(f"feature vectors of different widths: {width} are expected")
    return flat.reshape(n, width)


def _scores(x: np.ndarray, support: np.ndarray, y: np.ndarray, alpha: np.ndarray, outputs: int, kernel: str, options: dict) -> np.ndarray:
    """Scores of ``x`` by output, kernel values a tile at a time."""
    z = np.zeros((len(x), outputs))
    for i in range(0, len(x), ROWS):
        for j in range(0, len(support), SUPPORT):
            duals = np.zeros((len(y[j : j + SUPPORT]), outputs))
            duals[np.arange(len(duals)), y[j : j + SUPPORT]] = alpha[j : j + SUPPORT]
            z[i : i + ROWS] += KERNELS[kernel](x[i : i + ROWS], support[j : j + SUPPORT], **options) @ duals
    return z


def _online(x: np.ndarray, y: np.ndarray, w: np.ndarray, z: np.ndarray, kernel: str, options: dict) -> np.ndarray:
    """What each row of a block adds to its dual weight, given the scores from all before the block."""
    within, added = KERNELS[kernel](x, x, **options), np.zeros(len(x))
    for i in range(len(x)):
        row = z[i].copy()
        row[y[i]] -= 1
        if row.argmax() != y[i]:
            added[i] = w[i]
            z[:, y[i]] += w[i] * within[:, i]
    return added


class DualModel:
    """``support``: (key, x, y, alpha), y the number of the row's label in ``outputs``; alpha its dual weight."""

    def __init__(self, support: DataFrame, outputs: list[str], width: int, kernel: str, options: dict):
        self.support, self.outputs, self.width, self.kernel, self.options = support, outputs, width, kernel, options

    def _parts(self):
        """The support rows in parts of at most ``PART`` bytes: broadcasts of (x, y, alpha); or the one of their monomials' weights."""
        size = max(1, PART // (8 * (self.width + 2)))
        n = self.support.count()
        if monomials := Monomials.find(self.kernel, self.width, len(self.outputs), n, self.options):
            yield 1, self._weighed(monomials)
            return
        if n <= size:
            parts = [self.support]
        else:
            numbered = Scratch(self.support.sparkSession).write(position(self.support, [F.col("key"), F.col("y"), F.col("x")], "place").withColumn("part", F.floor(F.col("place") / size)).repartitionByRange("part"), "support")
            parts = [numbered.where(F.col("part") == i) for i in range(-(-n // size))]
        for part in parts:
            t = part.select("x", "y", "alpha").toArrow()
            yield len(parts), self.support.sparkSession.sparkContext.broadcast((_flat(t.column("x"), self.width), t.column("y").to_numpy(), t.column("alpha").to_numpy()))

    def _weighed(self, monomials: Monomials):
        """The weights of all support rows, summed where these lie: a broadcast of (monomials, weights)."""
        width, outputs = self.width, len(self.outputs)

        def partial(batches):
            total = np.zeros((len(monomials.at), outputs))
            for s in batches:
                total += monomials.weights(_flat(s.column("x"), width), s.column("y").to_numpy(), s.column("alpha").to_numpy(), outputs)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "weight"])

        sums = self.support.select("x", "y", "alpha").mapInArrow(partial, "at long, weight double").groupBy("at").agg(F.sum("weight").alias("weight")).toArrow()
        weights = np.zeros(len(monomials.at) * outputs)
        weights[sums.column("at").to_numpy()] = sums.column("weight").to_numpy()
        return self.support.sparkSession.sparkContext.broadcast((monomials, weights.reshape(-1, outputs)))

    def _scored(self, features: Column, sent) -> Column:
        width, outputs, kernel, options = self.width, len(self.outputs), self.kernel, self.options

        def scores(x: np.ndarray) -> np.ndarray:
            return sent.value[0].scores(x, sent.value[1]) if isinstance(sent.value[0], Monomials) else _scores(x, *sent.value, outputs, kernel, options)

        @F.arrow_udf("array<double>")
        def scored(x: pa.Array) -> pa.Array:
            known = np.asarray(x.is_valid())
            z = scores(_flat(x.filter(pa.array(known)), width))
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, outputs, dtype=np.int32)), pa.array(z.ravel()))
            return made.take(pa.array(np.maximum(np.cumsum(known) - 1, 0), mask=~known)) if len(z) else pa.nulls(len(x), pa.list_(pa.float64()))

        return scored(features)

    def predict(self, df: DataFrame, features: str, key: str | None = None) -> DataFrame:
        """``df`` with ``scores`` (in the order of ``outputs``) and ``prediction`` (ties to the first); null for features that are null or hold a null.

        Each part of the support rows is a pass over ``df``.  With more than one part, ``key`` must name a column that tells rows with different features apart, by which the parts' scores are added up.
        """
        whole = F.when(F.forall(features, lambda v: v.isNotNull()), F.col(features).cast("array<double>"))
        scratch, tables, out = Scratch(df.sparkSession), [], None
        for n, sent in self._parts():
            if n == 1:
                out = df.withColumn("scores", self._scored(whole, sent))
                break
            if key is None:
                raise ValueError(f"{n} parts of support rows need a key to add up their scores")
            distinct = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), whole.alias("_x")).where("_x IS NOT NULL").dropDuplicates(["_key"])
            tables.append(scratch.write(distinct.select("_key", self._scored(F.col("_x"), sent).alias("_z")), "scores"))
            sent.unpersist()
        if out is None:
            sums = tables[0]
            for t in tables[1:]:
                sums = sums.unionByName(t)
            sums = sums.groupBy("_key").agg(F.array(*[F.sum(F.get("_z", F.lit(i))) for i in range(len(self.outputs))]).alias("scores"))
            out = df.join(sums, df[key] == sums["_key"], "left").drop("_key")
        names = F.array(*[F.lit(o) for o in self.outputs])
        return out.withColumn("prediction", F.get(names, F.array_position("scores", F.array_max("scores")).cast("int") - 1))


def _merged(scratch: Scratch, tables: list[DataFrame]) -> list[DataFrame]:
    """Newly learnt rows (after the first table) as one table, where they are in too many."""
    if len(tables) <= TABLES:
        return tables
    merged = tables[1]
    for other in tables[2:]:
        merged = merged.unionByName(other)
    return [tables[0], scratch.write(merged.coalesce(8), "learnt")]


def _chained(scratch: Scratch, rows: DataFrame, n: int, block: int, monomials: Monomials, weights: np.ndarray, k: int, kernel: str, options: dict):
    """Of ``CHAIN`` blocks after the other (rows learnt from, weights after them).

    A task goes through its blocks in order and hands the weights on as a row of the table that it writes; the driver holds them, and no rows.
    """
    width, made = len(rows.first().x), rows.select("key", "x", "y", F.lit(0.0).alias("alpha")).schema
    for b in range(0, -(-n // block), CHAIN):
        sent = scratch.spark.sparkContext.broadcast(weights)

        def learnt(batches, sent=sent):
            total, kinds = sent.value.copy(), None
            for s in batches:
                kinds = s.schema
                for a in range(0, s.num_rows, block):  # however the rows are cut, the scores are those after all rows before
                    t = s.slice(a, block)
                    x, y = _flat(t.column("x"), width), t.column("y").to_numpy()
                    added = _online(x, y, t.column("w").to_numpy(), monomials.scores(x, total), kernel, options)
                    some = np.flatnonzero(added)
                    total += monomials.weights(x[some], y[some], added[some], k)
                    at = pa.array(some)
                    yield pa.RecordBatch.from_arrays([t.column("key").take(at), t.column("x").take(at), t.column("y").take(at), pa.array(added).take(at)], names=["key", "x", "y", "alpha"])
            if kinds is not None:
                last = [pa.nulls(1, kinds.field("key").type), pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([-1], pa.int32()), pa.array([0.0])]
                yield pa.RecordBatch.from_arrays(last, names=["key", "x", "y", "alpha"])

        some = rows.where((F.col("block") >= b) & (F.col("block") < b + CHAIN)).select("key", "x", "y", "w", "at")
        table = scratch.write(some.repartition(1).sortWithinPartitions("at").mapInArrow(learnt, made), "learnt")
        weights = np.array(table.where("y = -1").first().x).reshape(weights.shape)
        sent.unpersist()
        yield table.where("y >= 0"), weights


def fit(df: DataFrame, features: str, target: str, outputs: list[str], key: str, kernel: str = "rbf", epochs: int = 5, block: int = 1024, seed: int = 1, weight: str | None = None, order=None, **options) -> DualModel:
    """Learns from all rows in ``epochs`` passes, each in an order of its own.

    key: tells rows apart; rows that repeat are learnt from each time.  order: epoch -> columns to sort by before the key (default: a hash of seed, epoch and key).
    Rows whose features, target or key are null, that hold a null feature or whose label isn't in ``outputs`` take no part; a null or negative weight counts as 0.
    No rows, or feature vectors of different widths, are errors.
    """
    spark = df.sparkSession
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    number = F.array_position(F.array(*[F.lit(o) for o in outputs]), F.col(target)).cast("int") - 1
    known = df.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), number.alias("y"), w.alias("w")).where("key IS NOT NULL AND y >= 0 AND forall(x, v -> v IS NOT NULL)")
    scratch = Scratch(spark)
    known = scratch.write(known, "rows")
    first = known.first()
    if first is None:
        raise ValueError("no rows to learn from")
    width, k, n = len(first.x), len(outputs), known.count()
    empty = spark.createDataFrame([], known.select("key", "x", "y", F.lit(0.0).alias("alpha")).schema)
    made = empty.schema
    support = empty
    monomials = Monomials.find(kernel, width, k, n, options)
    weights = np.zeros((len(monomials.at), k)) if monomials else None
    for epoch in range(epochs):
        by = order(epoch) if order else [F.xxhash64(F.lit(seed), F.lit(epoch), "key")]
        rows = position(known, [*by, F.col("key"), F.col("y"), F.col("x"), F.col("w")], "at").withColumn("block", F.floor(F.col("at") / block))
        rows = scratch.write(rows.repartitionByRange("block").sortWithinPartitions("block", "at"), "epoch")
        tables = [support]
        if monomials:
            for table, weights in _chained(scratch, rows, n, block, monomials, weights, k, kernel, options):
                tables.append(table)
                tables = _merged(scratch, tables)
        for b in range(0 if monomials else -(-n // block)):
            t = rows.where(F.col("block") == b).orderBy("at").toArrow().combine_chunks()
            sent = spark.sparkContext.broadcast((_flat(t.column("x"), width), t.column("y").to_numpy(), t.column("w").to_numpy(), t.column("key").combine_chunks(), t.column("x").combine_chunks()))

            def partial(batches, sent=sent):
                z, x = None, sent.value[0]
                for s in batches:
                    more = _scores(x, _flat(s.column("x"), width), s.column("y").to_numpy(), s.column("alpha").to_numpy(), k, kernel, options)
                    z = more if z is None else z + more
                if z is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary())], names=["z"])

            def learnt(batches, sent=sent):
                x, y, u, keys, lists = sent.value
                z = np.zeros((len(x), k))
                for s in batches:
                    for bytes_ in s.column("z"):
                        if bytes_.is_valid:
                            z += np.frombuffer(bytes_.as_py()).reshape(z.shape)
                added = _online(x, y, u, z, kernel, options)
                some = pa.array(np.flatnonzero(added))
                yield pa.RecordBatch.from_arrays([keys.take(some), lists.take(some), pa.array(y).take(some), pa.array(added).take(some)], names=["key", "x", "y", "alpha"])

            held = tables[0]
            for other in tables[1:]:
                held = held.unionByName(other)
            # the one row beside the partial scores makes the last task run when there are none
            sums = held.mapInArrow(partial, "z binary").unionByName(spark.sql("SELECT CAST(NULL AS BINARY) AS z"))
            tables.append(scratch.write(sums.repartition(1).mapInArrow(learnt, made), "learnt"))
            tables = _merged(scratch, tables)
            sent.unpersist()
        held = tables[0]
        for other in tables[1:]:
            held = held.unionByName(other)
        support = scratch.write(held.groupBy("key", "x", "y").agg(F.sum("alpha").alias("alpha")), "support")
    return DualModel(support, outputs, width, kernel, options)
