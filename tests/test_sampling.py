"""Cumulative shares, draws, index views, sequences' features, typed tokens, matrices and extra trees, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import features, matrix, metrics, sampling, text, trees

WEIGHTS = [(i, float(w) if w is not None else None) for i, w in enumerate([3, 0, 0.1, None, -2, 50, 0.1, 0.2, 7, 1e-9] + [0.3] * 40)]


def test_cumulative_meets_at_its_ends(spark):
    got = sampling.cumulative(spark.createDataFrame(WEIGHTS, "id long, w double"), [F.col("id")], F.col("w")).orderBy("id").collect()
    assert len(got) == len(WEIGHTS) and got[0].low == 0 and got[-1].high == 1
    assert all(a.high == b.low for a, b in zip(got, got[1:]))
    total = sum(max(w or 0, 0) for _, w in WEIGHTS)
    assert all(math.isclose(r.high - r.low, max(r.w or 0, 0) / total, abs_tol=1e-12) for r in got)
    none = sampling.cumulative(spark.createDataFrame([(1, 0.0), (2, None)], "id long, w double"), [F.col("id")], F.col("w")).collect()
    assert all(r.low is None and r.high is None for r in none)


def test_weighted_bootstrap_against_search(spark):
    df = spark.createDataFrame([(i, w, i) for i, w in WEIGHTS], "id long, w double, draw_ long").withColumnRenamed("draw_", "at")
    edges = sampling.cumulative(df, [F.col("id")], F.col("w")).where("high > low").orderBy("low").select("id", "low").collect()
    u = [r[0] for r in spark.range(500).select(sampling._uniform(F.lit(9), F.col("id"))).collect()]
    want = [edges[np.searchsorted([e.low for e in edges], x, side="right") - 1].id for x in u]
    got = sampling.weighted_bootstrap(df, [F.col("id")], F.col("w"), 500, 9).orderBy("draw").collect()
    assert [g.draw for g in got] == list(range(500)) and [g.id for g in got] == want
    assert all(g.at == g.id for g in got)  # a column of the rows with a name of ours
    empty = df.where("false")
    assert sampling.weighted_bootstrap(empty, [F.col("id")], F.col("w"), 5, 9).count() == 0
    assert sampling.weighted_bootstrap(df, [F.col("id")], F.lit(0.0), 5, 9).count() == 0


def test_sampled_values(spark):
    df = spark.createDataFrame([(5.0,)] * 90 + [(2.0,)] * 10 + [(None,)], "x double")
    alike = dict(map(tuple, sampling.sample_values(df, "x", 1000, 3).groupBy("value").count().collect()))
    assert set(alike) == {5.0, 2.0} and abs(alike[5.0] - 500) < 80
    often = dict(map(tuple, sampling.sample_values(df, "x", 1000, 3, by_frequency=True, total=200).groupBy("value").count().collect()))
    assert set(often) == {0.0, 2.0, 5.0} and abs(often[0.0] - 500) < 80 and abs(often[5.0] - 450) < 80


def test_index_view_repeats(spark):
    df = spark.createDataFrame([(k,) for k in "dbca"], "k string")
    got = sampling.at_positions(df, [F.col("k")], spark.createDataFrame([(0,), (3,), (3,), (9,), (None,)], "position long"))
    assert sorted(r.k for r in got.collect()) == ["a", "d", "d"]


def test_sequences_lose_rare_features(spark):
    rows = [("s", 0, "a"), ("s", 1, "a"), ("s", 1, "rare"), ("t", 0, "a"), ("t", 1, "once"), (None, 0, "a")]
    got = features.minimum_cardinality_sequences(spark.createDataFrame(rows, "seq string, pos int, name string"), 2).where("seq IS NOT NULL")
    assert sorted((r.seq, r.pos, r.name) for r in got.collect()) == [("s", 0, "a"), ("s", 1, "a")]


def test_split_and_types(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c.alias("x")).first().x
    assert one(text.split_tokens(F.col("t"), around=",!"), "ab, c!d ") == ["ab", ",", "c", "!", "d"]
    assert one(text.split_tokens(F.col("t"), at="", before="A-Z"), "fooBarB") == ["foo", "Bar", "B"]
    assert one(text.split_tokens(F.col("t"), at="", after="-"), "a-b-") == ["a-", "b-"]
    assert one(text.split_tokens(F.col("t")), None) is None and one(text.split_tokens(F.col("t")), "") == []
    kinds = one(text.typed(F.split("t", "_")), "play_##ing_the_[UNK]_._ _two words_#")
    assert [k.type for k in kinds] == ["PREFIX", "SUFFIX", "WORD", "UNKNOWN", "PUNCTUATION", "WHITESPACE", "NGRAM", "PUNCTUATION"]


def test_matrices(spark):
    r = np.random.default_rng(4)
    a, b = r.integers(-3, 4, (5, 3)).astype(float), r.integers(-3, 4, (3, 6)).astype(float)
    df = lambda m: matrix.cells(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)] + [(None, [1.0]), (99, None)], "id long, x array<double>"), "id", F.col("x"))

    def dense(m, shape):
        out = np.zeros(shape)
        for c in m.collect():
            out[c.i, c.j] = c.v
        return out

    assert np.array_equal(dense(matrix.multiply(df(a), df(b)), (5, 6)), a @ b)
    assert np.array_equal(dense(matrix.transpose(df(a)), (3, 5)), a.T)
    assert np.array_equal(dense(matrix.add(df(a), df(a), -2.0), (5, 3)), -a)
    assert np.array_equal(dense(matrix.select_columns(df(a), [1]), (5, 3)), a * [0, 1, 0])
    rows = spark.createDataFrame([(row.tolist(),) for row in a] + [(None,)], "x array<double>")
    assert np.array_equal(dense(matrix.gram(rows, F.col("x"), 3), (3, 3)), a.T @ a)
    assert dict(map(tuple, matrix.row_sums(df(a)).collect())) == dict(enumerate(a.sum(1)))


def test_best(spark):
    df = spark.createDataFrame([("c", 0.5), ("b", 0.9), ("a", 0.9), ("d", None), ("e", float("nan"))], "name string, f1 double")
    assert metrics.best(df, "f1", "name").first().name == "a" and metrics.best(df, "f1", "name", highest=False).first().name == "c"


def test_extra_trees_against_plain_means(spark):
    """Scores are the means of the leaves that rows fall in, followed by hand; classes and two outputs at once are learnt."""
    r = np.random.default_rng(5)
    x = r.uniform(-1, 1, (400, 3))
    rows = [(i, v.tolist(), [float(v[0] > 0.1), float(2 * v[1])]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(1000, None, [1.0, 0.0]), (1001, [0.0, 0.0, 0.0], None)], "id long, v array<double>, y array<double>")
    m = trees.fit(df, "id", "v", "y", 2, members=3, depth=6, resample=False)
    leaves = {}

    def leaf(t, v):
        node = 1
        while (t, node) in m.splits:
            f, c = m.splits[t, node]
            node = 2 * node + int(v[f] > c)
        return t, node

    for _, v, y in rows:
        for t in range(3):
            leaves.setdefault(leaf(t, v), []).append(y)
    assert all(np.allclose(np.mean(ys, 0), m.means[k]) for k, ys in leaves.items())
    got = {g.id: g.scores for g in m.predict(df, "v").collect()}
    assert all(np.allclose(got[i], np.mean([m.means[leaf(t, v)] for t in range(3)], 0)) for i, v, _ in rows)
    assert got[1000] is None and got[1001] is not None
    many = {g.id: g.scores for g in trees.fit(df, "id", "v", "y", 2, members=10, depth=6).predict(df, "v").where("id < 1000").collect()}
    assert np.mean([(many[i][0] > 0.5) == (y[0] > 0.5) for i, _, y in rows]) > 0.95
    assert np.mean([(many[i][1] - y[1]) ** 2 for i, _, y in rows]) < 0.3 * np.var([y[1] for *_, y in rows])


def test_regression_far_from_zero(spark):
    """Values near 1e9 keep the digits of their spread; a null takes no part; weights of one give the same on small values."""
    y, p = [1.0, 2.0, 4.0, 7.0], [1.5, 2.0, 3.0, 7.5]
    e = [a - b for a, b in zip(y, p)]
    var = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)
    want = (1 - sum(x * x for x in e) / len(e) / var(y), 1 - var(e) / var(y))
    for far in (0.0, 1e9):
        df = spark.createDataFrame([(a + far, b + far) for a, b in zip(y, p)] + [(None, 1.0), (1.0, None)], "y double, p double")
        for weight in (None, *([F.lit(1.0)] if not far else [])):
            r = metrics.regression(df, F.col("y"), F.col("p"), weight).first()
            assert r.r2 == pytest.approx(want[0]) and r.explained_variance == pytest.approx(want[1])


@pytest.mark.parametrize("weight", [0.5, 5.0, 50.0, 5000.0])
def test_bootstrap_by_weight_has_no_end(spark, weight):
    """Poisson counts of any rate: mean and variance are the weight."""
    n = 4000 if weight < 1000 else 400
    got = [r.copies for r in sampling.bootstrap(spark.range(n).withColumn("w", F.lit(weight)), F.col("id"), 7, F.col("w")).collect()]
    got += [0] * (n - len(got))
    mean, var = np.mean(got), np.var(got)
    assert abs(mean - weight) < 5 * (weight / n) ** 0.5 and 0.75 < var / weight < 1.3


def test_bootstrap_without_a_weight(spark):
    odd = spark.createDataFrame([(1, None), (2, -3.0), (3, 0.0), (4, 1e-300)], "id long, w double")
    assert sampling.bootstrap(odd, F.col("id"), 1, F.col("w")).count() == 0


def test_running_sums_over_ranges(spark):
    """Sums in a total order, by group and over all; no task gets the rows of more than a range."""
    r = np.random.default_rng(3)
    rows = [(int(g), int(v), int(c)) for g, v, c in zip(r.integers(0, 3, 500), r.permutation(500), r.integers(1, 9, 500))]
    df = spark.createDataFrame(rows, "g int, v int, c long")
    for by in ([], ["g"]):
        out = sampling.running(df, [F.desc("v")], ["c"], by)
        for x in out.collect():
            own = [c for g, v, c in rows if not by or g == x.g]
            assert x.c_total == sum(own) and x.c_upto == sum(c for g, v, c in rows if v >= x.v and (not by or g == x.g))
    plan = sampling.running(df, [F.col("v")], ["c"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    assert sampling.running(df.where("g = 9"), [F.col("v")], ["c"]).count() == 0


def test_few_are_measured_in_bytes(spark, monkeypatch):
    from skarn.operators import transforms

    some = spark.range(100).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.array(F.lit(1.0), F.lit(2.0)).alias("fitted"), F.struct("id").alias("s"), F.lit(None).cast("string").alias("none"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(transforms.if_few(some)) and hinted(transforms.if_few(some.where("id < 0")))
    monkeypatch.setattr(transforms, "FEW", 100 * (32 + 16))
    wide = transforms.if_few(some)
    assert not hinted(wide) and sorted(map(str, wide.collect())) == sorted(map(str, some.collect()))
