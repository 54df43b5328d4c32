"""Entropy, mutual information and their weighted and conditional forms, in bits unless another base is named.

Everything is a count table over the joint states (one partial aggregate) and a sum over its
cells, so what is shuffled grows with the number of states, not of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _log(x: Column, base: float) -> Column:
    return F.ln(x) / math.log(base)


def counts(df: DataFrame, cols: list[str], weight: str | None = None) -> DataFrame:
    """Joint states with their count ``n`` (and, weighted, the mean weight ``w`` of the state)."""
    aggs = [F.count("*").cast("double").alias("n")]
    if weight:
        aggs.append((F.sum(weight) / F.count("*")).alias("w"))
    return df.groupBy(*cols).agg(*aggs)


def entropy(df: DataFrame, cols: list[str], weight: str | None = None, base: float = 2.0) -> Column | DataFrame:
    """One row: ``h`` = -sum w p log p over the joint states of ``cols``; w is 1 if unweighted."""
    c = counts(df, cols, weight)
    total = c.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    w = F.col("w") if weight else F.lit(1.0)
    return c.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(-w * p * _log(p, base)), F.lit(0.0)).alias("h"))


def conditional_entropy(df: DataFrame, x: list[str], y: list[str], weight: str | None = None, base: float = 2.0) -> DataFrame:
    """One row: ``h`` = H(x | y)."""
    joint = counts(df, [*x, *y], weight)
    marginal = joint.groupBy(*y).agg(F.sum("n").alias("ny"))
    total = joint.agg(F.sum("n").alias("total"))
    w = F.col("w") if weight else F.lit(1.0)
    return _on(joint, marginal, y).crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(-w * F.col("n") / F.col("total") * _log(F.col("n") / F.col("ny"), base)), F.lit(0.0)).alias("h"))


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe join on keys of the same names."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, cond).drop(*[f"_{k}" for k in keys])


def mutual_information(df: DataFrame, x: list[str], y: list[str], weight: str | None = None, base: float = 2.0) -> DataFrame:
    """One row: ``mi`` = I(x; y) and ``n`` rows; sets of columns count as their joint."""
    joint = counts(df, [*x, *y], weight)
    nx = joint.groupBy(*x).agg(F.sum("n").alias("nx"))
    ny = joint.groupBy(*y).agg(F.sum("n").alias("ny"))
    total = joint.agg(F.sum("n").alias("total"))
    w = F.col("w") if weight else F.lit(1.0)
    cells = _on(_on(joint, nx, x), ny, y).crossJoin(F.broadcast(total))
    term = w * F.col("n") / F.col("total") * _log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")), base)
    return cells.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("mi"), F.coalesce(F.sum("n"), F.lit(0.0)).cast("long").alias("n"))


def conditional_mutual_information(df: DataFrame, x: list[str], y: list[str], z: list[str], weight: str | None = None, base: float = 2.0) -> DataFrame:
    """One row: ``cmi`` = I(x; y | z)."""
    joint = counts(df, [*x, *y, *z], weight)
    nxz = joint.groupBy(*x, *z).agg(F.sum("n").alias("nxz"))
    nyz = joint.groupBy(*y, *z).agg(F.sum("n").alias("nyz"))
    nz = joint.groupBy(*z).agg(F.sum("n").alias("nz"))
    total = joint.agg(F.sum("n").alias("total"))
    w = F.col("w") if weight else F.lit(1.0)
    cells = _on(_on(_on(joint, nxz, [*x, *z]), nyz, [*y, *z]), nz, z).crossJoin(F.broadcast(total))
    term = w * F.col("n") / F.col("total") * _log(F.col("n") * F.col("nz") / (F.col("nxz") * F.col("nyz")), base)
    return cells.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("cmi"))


def g_statistic(df: DataFrame, x: str, y: str, z: list[str] | None = None) -> DataFrame:
    """One row: ``g`` = 2 n I(x; y) in nats (given z, if named), ``dof`` degrees of freedom and ``p`` the chi-squared probability up to g."""
    if z:
        mi = conditional_mutual_information(df, [x], [y], z, base=math.e).withColumnRenamed("cmi", "mi").crossJoin(df.agg(F.count("*").alias("n")))
        strata = df.agg(F.countDistinct(*z).alias("sz"))
    else:
        mi = mutual_information(df, [x], [y], base=math.e)
        strata = df.agg(F.lit(1).alias("sz"))
    sizes = df.agg(F.countDistinct(x).alias("sx"), F.countDistinct(y).alias("sy"))
    out = mi.crossJoin(sizes).crossJoin(strata).select((2 * F.col("n") * F.col("mi")).alias("g"), ((F.col("sx") - 1) * (F.col("sy") - 1) * F.col("sz")).cast("long").alias("dof"))

    def run(batches):
        for b in batches:
            b["p"] = [regularised_gamma_p(d / 2, g / 2) if d > 0 else float("nan") for g, d in zip(b["g"], b["dof"])]
            yield b

    return out.mapInPandas(run, "g double, dof long, p double")


def regularised_gamma_p(a: float, x: float) -> float:
    """Lower regularised incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300  # continued fraction
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def expected_mutual_information(rows: list[int], cols: list[int]) -> float:
    """E[MI] in nats of two partitions with these class sizes, by the hypergeometric model; bounded by classes, not rows."""
    n, lg, out = sum(rows), math.lgamma, 0.0
    for a in rows:
        for b in cols:
            for k in range(max(1, a + b - n), min(a, b) + 1):
                p = math.exp(lg(a + 1) + lg(b + 1) + lg(n - a + 1) + lg(n - b + 1) - lg(n + 1) - lg(k + 1) - lg(a - k + 1) - lg(b - k + 1) - lg(n - a - b + k + 1))
                out += k / n * math.log(n * k / (a * b)) * p
    return out


def binned(features: DataFrame, bins: int = 10) -> DataFrame:
    """Long features with ``bin`` 1 to ``bins`` of equal width by feature."""
    from skarn.operators.transforms import Bins

    step = Bins("equal_width", bins)
    return step.apply(features, step.fit(features)).withColumn("bin", F.col("value").cast("int"))


def grouped_mi(cells: DataFrame, by: list[str], x: list[str], y: list[str], n: str = "n") -> DataFrame:
    """(by..., mi): I(x; y) in bits within each group of a table of counts; further columns of the table are summed over."""
    joint = cells.groupBy(*by, *x, *y).agg(F.sum(n).cast("double").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*by, *c))
    joint = joint.select(*by, "n", over(*x).alias("nx"), over(*y).alias("ny"), over().alias("total"))
    return joint.groupBy(*by).agg(F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi"))


def mim(features: DataFrame, label: str, bins: int = 10) -> DataFrame:
    """name, mi: mutual information of each binned feature with the label, a column of the long features; one table of counts for all features."""
    return grouped_mi(binned(features, bins).groupBy("name", "bin", F.col(label).alias("y")).agg(F.count("*").alias("n")), ["name"], ["bin"], ["y"])


def pair_table(features: DataFrame, id_col: str, label: str, bins: int = 10):
    """Counts of (feature a, feature b, bin a, bin b, label): what greedy selection needs, bounded by features, bins and labels."""
    b = binned(features, bins).select(id_col, "name", "bin", F.col(label).alias("y"))
    # a row's features meet within its own array: nothing is joined
    held = b.groupBy(id_col, "y").agg(F.array_sort(F.collect_list(F.struct("name", "bin"))).alias("fs"))
    x = held.select("y", "fs", F.posexplode("fs").alias("i", "f"))
    pairs = x.select("y", "f", F.explode(F.slice("fs", F.col("i") + 1, F.size("fs"))).alias("g"))
    return pairs.groupBy(F.col("f.name").alias("a"), F.col("g.name").alias("b"), F.col("f.bin").alias("i"), F.col("g.bin").alias("j"), "y").agg(F.count("*").alias("n"))


def greedy_selection(features: DataFrame, id_col: str, label: str, how: str = "JMI", k: int = 10, bins: int = 10) -> list[tuple[str, float]]:
    """The k features chosen one by one, with the scores they were chosen by.

    JMI: greatest sum of I(f, s; y) over the chosen s.  mRMR: I(f; y) less the
    mean of I(f; s).  CMIM: greatest least I(f; y | s).  Ties by name.  The table of pair counts is made once and stays on the
    cluster; a round takes the pairs of the feature chosen last and brings back one number a feature.
    """
    pairs = pair_table(features, id_col, label, bins).persist()
    score = {r["a"]: r["mi"] for r in grouped_mi(pairs.where("a = b"), ["a"], ["i"], ["y"]).collect()}
    relevance, chosen, redundancy = dict(score), [], dict.fromkeys(score, 0.0)
    while len(chosen) < min(k, len(relevance)):
        left = [f for f in relevance if f not in {c for c, _ in chosen}]
        best = min(left, key=lambda f: (-score[f], f))
        chosen.append((best, score[best]))
        # the others' bins as x, those of the chosen one as s
        of = F.when(F.col("a") == best, F.col("b")).otherwise(F.col("a"))
        some = pairs.where(((F.col("a") == best) | (F.col("b") == best)) & (F.col("a") != F.col("b")))
        some = some.select(of.alias("f"), F.when(F.col("a") == best, F.col("j")).otherwise(F.col("i")).alias("x"), F.when(F.col("a") == best, F.col("i")).otherwise(F.col("j")).alias("s"), "y", "n")
        found = {r["f"]: r["mi"] for r in (grouped_mi(some, ["f"], ["x"], ["s"]) if how == "mRMR" else grouped_mi(some, ["f"], ["x", "s"], ["y"])).collect()}
        for f in left:
            if how == "mRMR":
                redundancy[f] += found.get(f, 0.0)
                score[f] = relevance[f] - redundancy[f] / len(chosen)
            elif how == "JMI":
                redundancy[f] += found.get(f, 0.0)
                score[f] = redundancy[f]
            else:
                score[f] = min(score[f], found.get(f, 0.0) - relevance[best])
    pairs.unpersist()
    return chosen
