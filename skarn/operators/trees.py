"""Extremely randomised trees over any number of outputs at once, all trees grown together, level by level.

A row's label is an array: one-hot for classes (the summed variance is then the Gini index), the values
themselves for joint regression.  A level takes two partial aggregates by (tree, node, feature); what reaches the
driver is the model: at most 2^depth nodes a tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.sampling import bootstrap

#: The deepest tree: the model is held in the plan as a literal map.
MOST_DEPTH = 10


def one_hot(label: Column, labels: list[str]) -> Column:
    """The outputs of a class; null for a null or unknown label, whose rows aren't learnt from."""
    return F.when(label.isin(labels), F.array(*[(label == l).cast("double") for l in labels]))


def _constants(values: list, kind: str) -> Column:
    """A constant array, written as one literal that is parsed once when the plan is made."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _descend(splits: dict, vector: Column, members: int, depth: int, tree: Column) -> Column:
    """The node of each row: 1 is the root, 2n and 2n + 1 are below n.  Nodes are looked up by place, tree after tree."""
    if not splits:
        return F.lit(1)
    size = 2 ** (depth + 1)
    places = [splits.get(divmod(i, size), (-1, 0.0)) for i in range(members * size)]
    features, cuts = _constants([f for f, _ in places], "int"), _constants([c for _, c in places], "double")

    def step(node: Column, _: Column) -> Column:
        f = F.get(features, tree * size + node)
        # an absent component is 0, as absent features are
        return F.when(f < 0, node).otherwise(node * 2 + (F.coalesce(F.get(vector, f), F.lit(0.0)) > F.get(cuts, tree * size + node)).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)


@dataclass
class ExtraTrees:
    """``splits`` by (tree, node): feature and threshold; ``means`` by (tree, node): the leaf's mean outputs."""

    splits: dict
    means: dict
    members: int
    depth: int

    def predict(self, df: DataFrame, vector: str) -> DataFrame:
        """``scores``: the trees' mean outputs, averaged; null for a null vector.  A column expression, without a join or Python."""
        v, size, width = F.col(vector).cast("array<double>"), 2 ** (self.depth + 1), len(next(iter(self.means.values())))
        grown = _constants(sorted({t for t, _ in self.means}), "int")  # a bootstrap of few rows may leave a tree without any
        df = df.withColumn("_leaves", F.transform(grown, lambda t: t * size + _descend(self.splits, v, self.members, self.depth, t)))
        means = [self.means.get(divmod(i, size), [0.0] * width) for i in range(self.members * size)]

        def mean(k: int) -> Column:
            of = _constants([m[k] for m in means], "double")
            return F.aggregate("_leaves", F.lit(0.0), lambda a, at: a + F.get(of, at)) / F.size("_leaves")

        return df.withColumn("scores", F.when(F.col(vector).isNotNull(), F.array(*map(mean, range(width))))).drop("_leaves")


def fit(df: DataFrame, key: str, vector: str, outputs: str, width: int, members: int = 10, depth: int = 5, fraction: float = 1.0, least: float = 1.0, seed: int = 1, resample: bool = True) -> ExtraTrees:
    """Each tree learns from its own bootstrap of the rows; each node splits at the best of one random threshold a feature, between the node's least and greatest value.

    ``width`` outputs; ``fraction`` of the features are looked at in a node; a child keeps ``least`` rows or more.
    Rows without a vector or outputs aren't learnt from; without any row it is an error.
    """
    if depth > MOST_DEPTH:
        raise ValueError(f"trees of more than {MOST_DEPTH} levels")
    rows = df.where(F.col(vector).isNotNull() & F.col(outputs).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.col(outputs).cast("array<double>").alias("y"))
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    rows = bootstrap(rows, F.struct("key", "tree"), seed) if resample else rows.withColumn("copies", F.lit(1))
    draw = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "tree", "node", "f"), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    sums = [F.sum(F.col("copies") * F.get("y", F.lit(k))).alias(f"s{k}") for k in range(width)]
    splits, means, grown = {}, {}, None
    for level in range(depth + 1):
        placed = rows.withColumn("node", _descend(splits, F.col("v"), members, max(level, 1), F.col("tree"))).where(F.col("node") >= 2**level)
        for r in placed.groupBy("tree", "node").agg(F.sum("copies").alias("n"), *sums).collect():  # the model's nodes
            means[r["tree"], r["node"]] = [r[f"s{k}"] / r["n"] for k in range(width)]
        if level == depth or (level and not grown):
            break
        values = placed.select("tree", "node", "copies", "y", F.posexplode("v").alias("f", "x")).where(F.col("x").isNotNull() & (draw("use") <= fraction))
        cuts = values.groupBy("tree", "node", "f").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("hi > lo").withColumn("c", F.col("lo") + draw("cut") * (F.col("hi") - F.col("lo"))).select("tree", "node", "f", "c")
        right = F.col("x") > F.col("c")
        parts = values.join(cuts, ["tree", "node", "f"]).groupBy("tree", "node", "f", "c").agg(
            F.sum(F.when(right, F.col("copies")).otherwise(0)).alias("nr"), F.sum(F.when(right, 0).otherwise(F.col("copies"))).alias("nl"),
            *[F.sum(F.when(right, F.col("copies") * F.get("y", F.lit(k))).otherwise(0.0)).alias(f"r{k}") for k in range(width)],
            *[F.sum(F.when(right, 0.0).otherwise(F.col("copies") * F.get("y", F.lit(k)))).alias(f"l{k}") for k in range(width)],
        ).where((F.col("nr") >= least) & (F.col("nl") >= least))
        square = lambda side: sum((F.pow(F.col(f"{side}{k}"), 2) for k in range(width)), F.lit(0.0)) / F.col(f"n{side}")
        whole = sum((F.pow(F.col(f"l{k}") + F.col(f"r{k}"), 2) for k in range(width)), F.lit(0.0)) / (F.col("nl") + F.col("nr"))
        gain = parts.withColumn("gain", square("l") + square("r") - whole).where("gain > 1e-12")
        grown = gain.groupBy("tree", "node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), "c")).alias("b")).collect()  # at most 2^level a tree
        splits |= {(r["tree"], r["node"]): (-r["b"]["f"], r["b"]["c"]) for r in grown}
    if not means:
        raise ValueError("no rows to learn from")
    return ExtraTrees(splits, means, members, depth)
