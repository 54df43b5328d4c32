"""Fit-then-apply column transformations, as aggregates and projections over the long form (id, name, value).

A fit is one aggregation by feature; applying it is a projection with the fitted rows (a handful
a feature) joined by name.  Chains fold left to right; later steps see
what earlier ones made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.sampling import running
from skarn.operators.scratch import Scratch


def simple(op: str, a: float = 0.0, b: float = 0.0):
    """exp, log, add, sub, mul, div by ``a``; binarise; threshold to [a, b]: a function of a column."""
    return {
        "exp": lambda x: F.exp(x),
        "log": lambda x: F.when(x > 0, F.ln(x)).otherwise(F.when(x == 0, float("-inf")).otherwise(float("nan"))),
        "add": lambda x: x + a,
        "sub": lambda x: x - a,
        "mul": lambda x: x * a,
        "div": lambda x: x / a,
        "binarise": lambda x: F.when(x < 1e-12, 0.0).otherwise(1.0),
        "threshold": lambda x: F.least(F.greatest(x, F.lit(a)), F.lit(b)),
    }[op]


#: Bytes of a fitted table that is broadcast; more are joined by a shuffle.
FEW = 64 << 20


def _bytes(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "string":
        return F.coalesce(F.octet_length(c), F.lit(0))
    if kind.startswith(("array<string", "map<", "struct<", "array<struct")):
        return F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
    return 8 * F.greatest(F.size(c), F.lit(0)) if kind.startswith("array<") else F.lit(16)


def if_few(fitted: DataFrame) -> DataFrame:
    """A table by feature name, broadcast if it has FEW bytes at most; it is written for the join that follows its measure."""
    fitted = Scratch(fitted.sparkSession).write(fitted, "fitted")
    size = fitted.agg(F.sum(sum((_bytes(n, t) for n, t in fitted.dtypes), F.lit(32)).cast("long"))).first()[0] or 0
    return F.broadcast(fitted) if size <= FEW else fitted


class Step:
    """A transformation: what to fit, and how to apply a fitted feature."""

    def fit(self, features: DataFrame) -> DataFrame:
        """(name, fitted columns...)."""
        raise NotImplementedError

    def apply(self, features: DataFrame, fitted: DataFrame) -> DataFrame:
        raise NotImplementedError

    def joined(self, features: DataFrame, fitted: DataFrame) -> DataFrame:
        return features.join(if_few(fitted), "name")


class Simple(Step):
    def __init__(self, op: str, a: float = 0.0, b: float = 0.0):
        self.f = simple(op, a, b)

    def fit(self, features):
        return features.select("name").distinct()

    def apply(self, features, fitted):
        return features.join(fitted, "name", "left_semi").withColumn("value", self.f(F.col("value")))


class MinMax(Step):
    """Linear scaling to [low, high]; values outside the fitted range are clamped; a constant feature becomes (high - low) / 2."""

    def __init__(self, low: float = 0.0, high: float = 1.0):
        self.low, self.high = low, high

    def fit(self, features):
        return features.groupBy("name").agg(F.min("value").alias("fit_min"), F.max("value").alias("fit_max"))

    def apply(self, features, fitted):
        x = F.least(F.greatest("value", "fit_min"), F.col("fit_max"))
        width = F.col("fit_max") - F.col("fit_min")
        scaled = F.when(width == 0, (self.high - self.low) / 2).otherwise((x - F.col("fit_min")) / width * (self.high - self.low) + self.low)
        return self.joined(features, fitted).withColumn("value", scaled).drop("fit_min", "fit_max")


class Standardise(Step):
    """To mean ``mean`` and sample deviation ``std``."""

    def __init__(self, mean: float = 0.0, std: float = 1.0):
        self.mean, self.std = mean, std

    def fit(self, features):
        return features.groupBy("name").agg(F.avg("value").alias("fit_mean"), F.stddev_samp("value").alias("fit_std"))

    def apply(self, features, fitted):
        z = F.when(F.col("fit_std") > 0, (F.col("value") - F.col("fit_mean")) / F.col("fit_std")).otherwise(0.0)
        return self.joined(features, fitted).withColumn("value", z * self.std + self.mean).drop("fit_mean", "fit_std")


class Bins(Step):
    """Bins 1 to ``n`` with upper-inclusive edges; values above the last edge fall in the last bin.

    kind: equal_width, equal_frequency (edges at every floor(count / n)-th sorted value), or std_devs (n even: edges at mean + k deviations).
    """

    def __init__(self, kind: str, n: int):
        self.kind, self.n = kind, n

    def fit(self, features):
        n = self.n
        if self.kind == "equal_width":
            edges = F.array(*[F.col("lo") + (F.col("hi") - F.col("lo")) * (i + 1) / n for i in range(n)])
            return features.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select("name", edges.alias("edges"))
        if self.kind == "std_devs":
            half = n // 2
            edges = F.array(*[F.col("m") + F.col("s") * k for k in range(-half + 1, half + 1)])
            return features.groupBy("name").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).select("name", edges.alias("edges"))
        # ranks by running counts of distinct values
        counts = features.groupBy("name", "value").agg(F.count("*").alias("c"))
        ranked = running(counts, [F.col("value")], ["c"], ["name"])
        step = F.floor(F.col("c_total") / n)
        # the value at 0-based sorted place (i + 1) * step
        wanted = F.filter(F.array(*[F.least(step * (i + 1), F.col("c_total") - 1) for i in range(n)]), lambda at: (F.col("c_upto") > at) & (F.col("c_upto") - F.col("c") <= at))
        placed = ranked.select("name", "value", F.explode(wanted).alias("at"))
        return placed.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("edges"))

    def apply(self, features, fitted):
        below = sum((F.when(F.get("edges", F.lit(i)) < F.col("value"), 1).otherwise(0) for i in range(self.n)), F.lit(1))
        return self.joined(features, fitted).withColumn("value", F.least(below, F.lit(self.n)).cast("double")).drop("edges")


class Idf(Step):
    """ln(N / df) (1 + ln tf): N rows in all, df rows with the feature."""

    def __init__(self, n_rows: int, id_col: str = "id"):
        self.n_rows, self.id_col = n_rows, id_col

    def fit(self, features):
        return features.where("value <> 0").groupBy("name").agg(F.countDistinct(self.id_col).alias("df"))

    def apply(self, features, fitted):
        tf = F.when(F.col("value") > 0, 1 + F.ln("value")).otherwise(0.0)
        return self.joined(features, fitted).withColumn("value", F.ln(F.lit(float(self.n_rows)) / F.col("df")) * tf).drop("df")


def chain(features: DataFrame, everywhere: list[Step] = (), by_pattern: dict[str, list[Step]] | None = None) -> DataFrame:
    """Fits and applies steps: those of the pattern that a feature's name matches first, then those for all.

    A feature that matches two patterns is an error.  Each step fits on what the one before made.
    """
    by_pattern = by_pattern or {}
    if by_pattern:
        hits = F.filter(F.array(*[F.when(F.col("name").rlike(f"^(?:{p})$"), F.lit(p)) for p in by_pattern]), lambda p: p.isNotNull())
        twice = features.select("name").distinct().select("name", hits.alias("hits")).where(F.size("hits") > 1).first()
        if twice:
            raise ValueError(f"feature {twice['name']} matches several patterns: {twice['hits']}")
        parts = []
        for pattern, steps in by_pattern.items():
            some = features.where(F.col("name").rlike(f"^(?:{pattern})$"))
            for s in steps:
                some = s.apply(some, s.fit(some)).select(*features.columns)
            parts.append(some)
        rest = features.where(~F.col("name").rlike("|".join(f"^(?:{p})$" for p in by_pattern)))
        for p in parts:
            rest = rest.unionByName(p)
        features = rest
    for s in everywhere:
        features = s.apply(features, s.fit(features)).select(*features.columns)
    return features
