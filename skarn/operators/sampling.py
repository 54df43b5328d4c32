"""Splits, folds, bootstraps and permutations, decided by hashes of keys: the same on any cluster and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.scratch import Scratch


#: Poisson rates above this are drawn in parts.
RATE = 256


def position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows numbered from 0 in a total order, in two steps: ranges of the order are sorted apart, each set off by the rows before it.

    The ranges are written: they are read twice, and cut anew, after the loss of an executor say, they could come out otherwise.
    """
    ranged = Scratch(df.sparkSession).write(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    low = ranged.groupBy("_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    low = low.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # over partitions
    return ranged.join(F.broadcast(low), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_low")).drop("_part", "_at", "_low", "_n", "_before")


def running(df: DataFrame, order: list[Column], values: list[str], by: list[str] | None = None) -> DataFrame:
    """``v_upto`` and ``v_total`` for each of ``values``: the sum up to a row, it included, in a total order, and over all rows; ``by`` columns each have sums of their own.

    Ranges of the order are cut once, written, and summed apart; what meets beyond a range is one row of sums for it (and each ``by`` in it), never its rows.
    """
    by = by or []
    ranged = Scratch(df.sparkSession).write(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_part", *by).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    over = Window.partitionBy(*by).orderBy("_part")  # over ranges
    before = [F.coalesce(F.sum(f"_{v}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_before_{v}") for v in values]
    total = [F.sum(f"_{v}").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{v}_total") for v in values]
    sums = sums.select("_part", *by, *before, *total)
    own = ranged.select("*", *[F.sum(v).over(inner).alias(f"_own_{v}") for v in values])
    out = own.join(sums if by else F.broadcast(sums), ["_part", *by])  # without ``by`` a row a range
    for v in values:
        out = out.withColumn(f"{v}_upto", F.col(f"_own_{v}") + F.col(f"_before_{v}"))
    return out.drop("_part", *[f"_own_{v}" for v in values], *[f"_before_{v}" for v in values])


def shuffled(key: Column, seed: int) -> list[Column]:
    """A pseudo-random total order of a unique key."""
    return [F.xxhash64(F.lit(seed), key), key]


def train_test(df: DataFrame, order: list[Column], train: float = 0.7) -> DataFrame:
    """``split``: train for the first floor(train * n) rows of the order, test for the others."""
    n = df.count()
    return position(df, order).withColumn("split", F.when(F.col("position") < int(train * n), "train").otherwise("test")).drop("position")


def k_folds(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """``fold`` 0 to k - 1: contiguous blocks of the order; the first n % k folds have a row more."""
    n = df.count()
    size, extra = divmod(n, k)
    p = F.col("position")
    edge = extra * (size + 1)
    fold = F.when(p < edge, F.floor(p / (size + 1))).otherwise(extra + F.floor((p - edge) / max(size, 1)))
    return position(df, order).withColumn("fold", fold.cast("int")).drop("position")


def _uniform(*cols) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


def bootstrap(df: DataFrame, key: Column, seed: int, weight: Column | None = None) -> DataFrame:
    """``copies``: how often a row is drawn in a bootstrap, each row by itself (Poisson of mean 1, or of its weight); rows never drawn are gone.

    Independent Poisson counts are the limit of n draws with replacement, and need no pass over the others.
    Null and negative weights count as none; no weight is too large.
    """
    rate = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0)) if weight is not None else F.lit(1.0)
    # a Poisson count of a large rate is a sum of counts of equal parts of it, whose exponentials don't vanish
    parts = F.greatest(F.ceil(rate / RATE), F.lit(1)).cast("int")
    share = rate / parts
    # beyond this many the chance is below that of any of the 2**53 numbers drawn
    most = F.ceil(share + 9 * F.sqrt(share) + 20).cast("int")

    def count(u: Column) -> Column:
        def next_(s, i):
            p = s.p * share / i
            return F.struct(p.alias("p"), (s.upto + p).alias("upto"), (s.n + F.when(u > s.upto, 1).otherwise(0)).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), most), F.struct(F.exp(-share).alias("p"), F.exp(-share).alias("upto"), F.lit(0).alias("n")), next_, lambda s: s.n)

    first = count(_uniform(F.lit(seed), key))
    others = F.aggregate(F.filter(F.sequence(F.lit(0), parts - 1), lambda j: j > 0), F.lit(0), lambda a, j: a + count(_uniform(F.lit(seed), key, j)))
    copies = first if weight is None else first + others
    return df.withColumn("copies", copies).where("copies > 0")


def sample_without_replacement(df: DataFrame, key: Column, n: int, seed: int, weight: Column | None = None) -> DataFrame:
    """n rows, by weight: the n greatest u^(1/w) (here as ln u / w), a distributed top-n."""
    w = weight if weight is not None else F.lit(1.0)
    return df.orderBy(F.desc(F.ln(_uniform(F.lit(seed), key)) / w)).limit(n)


def cross_validate(df: DataFrame, order: list[Column], k: int, evaluate) -> DataFrame:
    """The union of ``evaluate(train, test)`` (one row each) over k folds, with the fold's number."""
    folds = k_folds(df, order, k)
    out = None
    for i in range(k):
        part = evaluate(folds.where(F.col("fold") != i).drop("fold"), folds.where(F.col("fold") == i).drop("fold")).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def at_positions(df: DataFrame, order: list[Column], indices: DataFrame) -> DataFrame:
    """The rows at the positions (from 0, in a total order) that ``indices`` lists in its column ``position``, as often as listed; positions beyond the rows give none."""
    return indices.select(F.col("position").cast("long")).join(position(df, order), "position")


def cumulative(df: DataFrame, order: list[Column], weight: Column) -> DataFrame:
    """``low`` and ``high``: the share of the total weight before each row and with it, in a total order; null and negative weights count as none.

    Ranges of the order are summed apart and set off by the ranges before them; each ``low`` is the ``high`` before it to the last bit.
    Without any weight both are null.
    """
    w = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    ranged = Scratch(df.sparkSession).write(df.withColumn("_w", w).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("_run", F.sum("_w").over(inner)).withColumn("_prior", F.coalesce(F.lag("_run").over(Window.partitionBy("_part").orderBy(*order)), F.lit(0.0)))
    sums = ranged.groupBy("_part").agg(F.max("_run").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # over ranges
    sums = sums.withColumn("_before", before).withColumn("_total", F.max(F.col("_before") + F.col("_sum")).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = lambda c: F.try_divide(F.col("_before") + F.col(c), F.col("_total"))
    return ranged.join(F.broadcast(sums), "_part").withColumn("low", share("_prior")).withColumn("high", share("_run")).drop("_w", "_part", "_run", "_prior", "_sum", "_before", "_total")


def weighted_bootstrap(df: DataFrame, order: list[Column], weight: Column, n: int, seed: int) -> DataFrame:
    """``draw`` 0 to n - 1 and the row that each takes: n draws with replacement, by shares of the weight; no draws where there is no weight.

    Draws and rows are sorted together by ranges of the cumulative weight, and each draw takes the last row at or before it:
    nothing is paired off, and neither a heavy row nor many light ones meet in one task.
    """
    columns = df.columns
    rows = cumulative(df, order, weight).where("high > low").select(F.col("low").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("draw"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    drawn = df.sparkSession.range(n).select(_uniform(F.lit(seed), F.col("id")).alias("at"), F.lit(1).alias("kind"), F.col("id").alias("draw"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    ranged = Scratch(df.sparkSession).write(rows.unionByName(drawn).repartitionByRange("at", "kind").withColumn("_part", F.spark_partition_id()), "ranges")
    inside = F.last("row", ignorenulls=True).over(Window.partitionBy("_part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    tails = ranged.groupBy("_part").agg(F.max_by("row", F.when(F.col("kind") == 0, F.col("at"))).alias("_tail"))
    tails = tails.select("_part", F.last("_tail", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_tail"))  # over ranges
    found = ranged.withColumn("row", inside).where("kind = 1").join(F.broadcast(tails), "_part").select("draw", F.coalesce("row", "_tail").alias("row"))
    return found.where("row IS NOT NULL").select("draw", "row.*")


def sample_values(df: DataFrame, col: str, n: int, seed: int, by_frequency: bool = False, total: int | None = None) -> DataFrame:
    """``draw`` and ``value``: n draws with replacement from the distinct non-null values, each alike or by how often it occurs.

    By frequency, ``total`` observations beyond those counted are zeros.
    """
    held = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    if by_frequency:
        if total is not None:
            zeros = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(0).cast(held.schema["value"].dataType).alias("value"), (F.lit(total) - F.col("n")).alias("n"))
            held = held.unionByName(zeros.where("n > 0")).groupBy("value").agg(F.sum("n").alias("n"))
        return weighted_bootstrap(held, [F.col("value")], F.col("n"), n, seed).select("draw", "value")
    return weighted_bootstrap(held, [F.col("value")], F.lit(1.0), n, seed).select("draw", "value")
