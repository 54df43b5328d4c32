"""Trees that split at the best threshold, for one output each or all outputs jointly, all trees grown together, level by level.

Values are dealt once to bins by feature: every value has its own where a feature has ``bins`` values or fewer, else they are quantiles.
A level is one partial aggregate by (tree, node, feature, bin); running sums over the bins give every threshold's two sides, and only each
node's best split reaches the driver.  For the absolute error a second pass adds up the deviations from the means of both sides of every threshold.
Without features of more than ``bins`` values the trees are those of a search over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.linear import matrix
from skarn.operators.sampling import bootstrap
from skarn.operators.scratch import Scratch
from skarn.operators.trees import MOST_DEPTH, ExtraTrees, _descend

IMPURITIES = ("squared", "absolute", "entropy")
#: Bin edges of all features together.
MOST_EDGES = 5_000_000
#: Means that go to the tasks of one pass for the absolute error; the nodes of a level are taken in as many passes as that needs.
MOST_SENT = 8_000_000


@dataclass
class Trees:
    """``parts``: one forest of all outputs (joint), or one for each output."""

    parts: list[ExtraTrees]

    def predict(self, df: DataFrame, vector: str) -> DataFrame:
        """``scores``: the outputs' means, averaged over the trees; null for a null vector."""
        names = []
        for i, part in enumerate(self.parts):
            df = part.predict(df, vector).withColumnRenamed("scores", f"_scores{i}")
            names.append(f"_scores{i}")
        return df.withColumn("scores", F.concat(*names)).drop(*names)

    def split_counts(self) -> dict[int, int]:
        """How many nodes split on each feature."""
        out: dict[int, int] = {}
        for part in self.parts:
            for f, _ in part.splits.values():
                out[f] = out.get(f, 0) + 1
        return out


def _dense(vector: str, width: int):
    """``width`` components; an absent one (null, NaN or beyond the vector's end) is 0."""
    return F.array(*[F.coalesce(F.nanvl(F.get(vector, F.lit(i)), F.lit(0.0)), F.lit(0.0)) for i in range(width)])


def bin_edges(rows: DataFrame, vector: str, width: int, bins: int) -> list[np.ndarray]:
    """Ascending upper bounds of each feature's bins: all values if there are ``bins`` at most, else that many quantiles."""
    if width * bins > MOST_EDGES:
        raise ValueError(f"{width} features of {bins} bins are beyond the bound of {MOST_EDGES} edges")

    def run(batches):
        held = [np.empty(0)] * width
        for b in batches:
            x = matrix(b, "v") if b.num_rows else np.empty((0, width))
            for f in range(width):
                if held[f] is not None:
                    u = np.union1d(held[f], x[:, f])
                    held[f] = u if len(u) <= bins else None
        for f, u in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(1 if u is None else len(u), f, np.int32)), pa.array([None] if u is None else u, pa.float64())], names=["f", "x"])

    seen = rows.select(F.col(vector).alias("v")).mapInArrow(run, "f int, x double").distinct()  # tasks x features x bins at most
    counts = seen.groupBy("f").agg(F.count("x").alias("n"), F.max(F.col("x").isNull()).alias("many")).collect()
    few = [r.f for r in counts if not r.many and r.n <= bins]
    edges: dict[int, np.ndarray] = {f: np.empty(0) for f in range(width)}
    if few:
        for r in seen.where(F.col("f").isin(few)).groupBy("f").agg(F.array_sort(F.collect_list("x")).alias("x")).collect():  # bins a feature at most
            edges[r.f] = np.array(r.x)
    if len(few) < len(counts):
        values = rows.select(F.posexplode(vector).alias("f", "x")).where(~F.col("f").isin(few))
        for r in values.groupBy("f").agg(F.percentile_approx("x", [i / bins for i in range(1, bins + 1)], 10 * bins).alias("x")).collect():
            edges[r.f] = np.unique(r.x)
    return [edges[f] for f in range(width)]


def _deviations(placed: DataFrame, sides: DataFrame, width: int, n_bins: int, n_out: int) -> DataFrame:
    """(tree, node, f, b, dev): for every threshold the weighted absolute deviations of its rows from the mean of their side, over all outputs."""
    nodes = [(r.tree, r.node) for r in sides.select("tree", "node").distinct().orderBy("tree", "node").collect()]  # the level's nodes
    at_once = max(1, MOST_SENT // (2 * width * n_bins * n_out))
    out = None
    for first in range(0, len(nodes), at_once):
        group = {n: i for i, n in enumerate(nodes[first : first + at_once])}
        listed = placed.sparkSession.createDataFrame([(*n, i) for n, i in group.items()], "tree int, node int, i int")
        means = np.zeros((2, len(group), width, n_bins, n_out))
        for r in sides.join(F.broadcast(listed), ["tree", "node"]).select("i", "f", "b", "left", "right").toLocalIterator():  # MOST_SENT numbers
            means[:, r.i, r.f, r.b] = r.left, r.right
        sent = placed.sparkSession.sparkContext.broadcast(means)

        def run(batches, sent=sent, shape=(len(group), width, n_bins)):
            total, (left, right), cuts = np.zeros(shape), sent.value, np.arange(n_bins)
            for batch in batches:
                if not batch.num_rows:
                    continue
                number, bins, y, w = batch.column("i").to_numpy(), matrix(batch, "bins"), matrix(batch, "y"), batch.column("w").to_numpy()
                for i in np.unique(number).tolist():
                    of = np.flatnonzero(number == i)
                    for a in range(0, len(of), 1024):
                        part = of[a : a + 1024]
                        for f in range(width):
                            below = bins[part, f][:, None] <= cuts
                            for k in range(y.shape[1]):
                                t = y[part, k][:, None]
                                total[i, f] += w[part] @ np.abs(t - np.where(below, left[i, f, :, k], right[i, f, :, k]))
            i, f, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[i, f, b])], names=["i", "f", "b", "dev"])

        rows = placed.join(F.broadcast(listed), ["tree", "node"]).select("i", "bins", "y", "w")
        found = rows.mapInArrow(run, "i int, f int, b int, dev double").groupBy("i", "f", "b").agg(F.sum("dev").alias("dev"))
        found = found.join(F.broadcast(listed), "i").drop("i")
        out = found if out is None else out.unionByName(found)
    return out


def _best(placed: DataFrame, impurity: str, width: int, n_bins: int, n_out: int, fraction: float, least_child: float, least_gain: float, seed: int) -> dict:
    """The best split of each node: (tree, node) to (feature, threshold); of equal gains the first feature's, and of these the lowest threshold."""
    outs = range(n_out)
    draw = (F.pmod(F.xxhash64(F.lit(seed), "tree", "node", "f"), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    zipped = F.posexplode(F.arrays_zip("bins", "v")).alias("f", "z")
    values = placed.select("tree", "node", "w", "y", zipped).where(draw <= fraction).select("tree", "node", "w", "y", "f", F.col("z.bins").alias("b"), F.col("z.v").alias("x"))
    sums = [F.sum(F.col("w") * F.get("y", F.lit(k))).alias(f"s{k}") for k in outs]
    table = values.groupBy("tree", "node", "f", "b").agg(F.sum("w").alias("n"), *sums, F.min("x").alias("lo"), F.max("x").alias("hi"))
    whole = Window.partitionBy("tree", "node", "f")
    ordered = whole.orderBy("b")
    run = ordered.rowsBetween(Window.unboundedPreceding, 0)
    sides = table.select(
        "tree", "node", "f", "b", F.sum("n").over(run).alias("nl"), F.sum("n").over(whole).alias("n"), ((F.col("hi") + F.lead("lo").over(ordered)) / 2).alias("cut"),
        *[F.sum(f"s{k}").over(run).alias(f"l{k}") for k in outs], *[F.sum(f"s{k}").over(whole).alias(f"t{k}") for k in outs],
    ).withColumn("nr", F.col("n") - F.col("nl"))
    split = F.col("cut").isNotNull()  # the last bin has nothing above it
    if impurity == "absolute":
        left = F.array(*[F.col(f"l{k}") / F.col("nl") for k in outs])
        right = F.when(split, F.array(*[(F.col(f"t{k}") - F.col(f"l{k}")) / F.col("nr") for k in outs])).otherwise(left)
        scratch = Scratch(placed.sparkSession)
        sides = scratch.write(sides.select("tree", "node", "f", "b", "n", "nl", "nr", "cut", left.alias("left"), right.alias("right")), "sides")
        if sides.isEmpty():
            return {}
        dev = _deviations(placed, sides, width, n_bins, n_out)
        sides = sides.drop("left", "right").join(dev, ["tree", "node", "f", "b"], "left").withColumn("dev", F.coalesce("dev", F.lit(0.0)))
        sides = sides.withColumn("gain", (F.max(F.when(~split, F.col("dev"))).over(whole) - F.col("dev")) / n_out)
    elif impurity == "squared":
        apart = [F.col(f"l{k}") / F.col("nl") - (F.col(f"t{k}") - F.col(f"l{k}")) / F.col("nr") for k in outs]
        sides = sides.withColumn("gain", F.when(split, F.col("nl") * F.col("nr") / F.col("n") * sum((a * a for a in apart), F.lit(0.0)) / n_out))
    else:
        term = lambda s, n: F.when(s > 1e-10 * n, s * F.ln(s / n)).otherwise(0.0)
        gains = [term(F.col(f"l{k}"), F.col("nl")) + term(F.col(f"t{k}") - F.col(f"l{k}"), F.col("nr")) - term(F.col(f"t{k}"), F.col("n")) for k in outs]
        sides = sides.withColumn("gain", F.when(split, sum(gains, F.lit(0.0))))
    kept = sides.where(split & (F.col("gain") > 1e-12 * F.col("n")) & (F.col("gain") >= least_gain) & (F.col("nl") >= least_child) & (F.col("nr") >= least_child))
    best = kept.groupBy("tree", "node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("cut")).alias("cut"))).alias("s")).collect()  # at most 2^level a tree
    if impurity == "absolute":
        scratch.clear()
    return {(r.tree, r.node): (-r.s.f, -r.s.cut) for r in best}


def fit(df: DataFrame, vector: str, outputs: str, width: int, n_outputs: int, impurity: str = "squared", joint: bool = True, depth: int = 5, bins: int = 256, least_node: float = 5.0, least_child: float = 0.0, least_decrease: float = 0.0, fraction: float = 1.0, weight: str | None = None, members: int = 1, key: str | None = None, seed: int = 1) -> Trees:
    """Grows trees of up to ``depth`` splits over ``width`` features for ``n_outputs`` outputs (an array of numbers, one-hot for classes).

    impurity: the mean over the outputs of the weighted squared or absolute error around the node's mean, or the entropy of one-hot outputs
    (whose squared error is the Gini index over n_outputs).  joint: one tree for all outputs, else one for each.
    A node of less weight than ``least_node`` isn't split, nor is a child lighter than ``least_child`` made, nor a split whose decrease of impurity, as a share
    of the whole weight, is less than ``least_decrease``.  fraction: the chance of each feature to be looked at in a node.
    members: more than one are grown from bootstraps, for which ``key`` tells rows apart.
    Rows without a vector or outputs, and of no positive weight, aren't learnt from; without any row it is an error.
    """
    if impurity not in IMPURITIES:
        raise ValueError(impurity)
    if depth > MOST_DEPTH:
        raise ValueError(f"trees of more than {MOST_DEPTH} levels")
    if members > 1 and key is None:
        raise ValueError("bootstraps need a key")
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    rows = df.where(F.col(vector).isNotNull() & F.col(outputs).isNotNull()).select((F.col(key) if key else F.lit(None)).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.col(outputs).cast("array<double>").alias("y"), w.alias("w")).where("w > 0")
    if impurity == "entropy":
        centre = [0.0] * n_outputs
    else:  # sums of numbers around their mean lose no digits
        centre = list(rows.agg(*[F.coalesce(F.try_divide(F.sum(F.col("w") * F.get("y", F.lit(k))), F.sum("w")), F.lit(0.0)) for k in range(n_outputs)]).first())
    rows = rows.withColumn("v", _dense("v", width)).withColumn("y", F.array(*[F.get("y", F.lit(k)) - c for k, c in enumerate(centre)]))
    edges = bin_edges(rows, "v", width, bins)
    n_bins = max(map(len, edges), default=0) + 1
    sent = df.sparkSession.sparkContext.broadcast(edges)

    @F.arrow_udf("array<int>")
    def binned(x: pa.Array) -> pa.Array:
        m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)
        b = np.stack([np.searchsorted(e, m[:, f]) for f, e in enumerate(sent.value)], axis=1) if len(m) else np.empty((0, width))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, b.size + 1, width, dtype=np.int32)), pa.array(b.ravel().astype(np.int32)))

    scratch = Scratch(df.sparkSession)
    rows = scratch.write(rows.withColumn("bins", binned("v")), "binned")
    groups, n_out = (1, n_outputs) if joint else (n_outputs, 1)
    trees = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(members * groups - 1))))
    if members > 1:  # the trees of one member's outputs share its rows
        drawn = bootstrap(trees.withColumn("member", F.floor(F.col("tree") / groups)), F.struct("key", "member"), seed)
        trees = drawn.withColumn("w", F.col("w") * F.col("copies")).drop("copies", "member")
    if not joint:
        trees = trees.withColumn("y", F.array(F.get("y", F.col("tree") % groups)))
    splits: dict = {}
    means: dict = {}
    total: dict = {}
    grown: dict = {}
    for level in range(depth + 1):
        placed = trees.withColumn("node", _descend(splits, F.col("v"), members * groups, max(level, 1), F.col("tree"))).where(F.col("node") >= 2**level)
        sums = [F.sum(F.col("w") * F.get("y", F.lit(k))).alias(f"s{k}") for k in range(n_out)]
        open_nodes = []
        for r in placed.groupBy("tree", "node").agg(F.sum("w").alias("n"), *sums).collect():  # the model's nodes
            means[r.tree, r.node] = [r[f"s{k}"] / r.n + centre[k if joint else r.tree % groups] for k in range(n_out)]
            if r.node == 1:
                total[r.tree] = r.n
            if r.n >= least_node:
                open_nodes.append((r.tree, r.node))
        if level == depth or not open_nodes or (level and not grown):
            break
        listed = df.sparkSession.createDataFrame(open_nodes, "tree int, node int")
        placed = placed.join(F.broadcast(listed), ["tree", "node"])
        grown = _best(placed, impurity, width, n_bins, n_out, fraction, least_child, least_decrease * min(total.values()), seed)
        splits |= grown
    scratch.clear()
    if not means:
        raise ValueError("no rows to learn from")
    parts = []
    for g in range(groups):
        own = lambda d, g=g: {(t // groups, n): v for (t, n), v in d.items() if t % groups == g}
        parts.append(ExtraTrees(own(splits), own(means), members, depth))
    return Trees(parts)
