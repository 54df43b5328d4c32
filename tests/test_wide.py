"""Mini-batch descent and linear models of any width against plain numpy."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import linear, wide
from skarn.operators.scratch import Scratch


def _labelled(spark, n=3000, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 5))
    y = np.array(["a", "b", "c"])[(x @ r.normal(size=(5, 3)) + r.normal(size=(n, 3)) * 0.3).argmax(axis=1)]
    return spark.createDataFrame([(i, v.tolist(), str(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, label string"), x, y


def _mean_loss(m, x, y):
    z = np.hstack([x, np.ones((len(x), 1))]) @ m.weights
    return linear.OBJECTIVES["log"](z, (y[:, None] == np.array(m.outputs)[None]).astype(float))[0].mean()


def test_mini_batches_need_a_tenth_of_the_passes(spark):
    df, x, y = _labelled(spark)
    full = linear.fit(df, "x", "label", list("abc"), optimiser=linear.Optimiser("sgd", 0.5), epochs=40)
    small = linear.fit(df, "x", "label", list("abc"), optimiser=linear.Optimiser("sgd", 0.5), epochs=4, batch=16, key="id", shards=4)
    assert _mean_loss(small, x, y) <= _mean_loss(full, x, y)
    assert small.predict(df, "x").where("prediction = label").count() > 0.9 * len(x)


@pytest.mark.parametrize("kind", ["sgd", "adagrad", "adam"])
def test_mini_batches_give_one_model_on_any_partitioning(spark, kind):
    df, *_ = _labelled(spark, 500)
    made = [linear.fit(part, "x", "label", list("abc"), optimiser=linear.Optimiser(kind, 0.3, "sqrt"), epochs=2, batch=32, key="id", shards=5).weights for part in (df.repartition(1), df.repartition(7).orderBy(F.desc("id")))]
    assert np.array_equal(*made)
    other = linear.fit(df, "x", "label", list("abc"), optimiser=linear.Optimiser(kind, 0.3, "sqrt"), epochs=2, batch=32, key="id", shards=5, seed=2)
    assert not np.array_equal(made[0], other.weights)


def test_one_shard_is_plain_mini_batch_descent(spark):
    df, x, y = _labelled(spark, 203)
    got = linear.fit(df, "x", "label", list("abc"), optimiser=linear.Optimiser("adagrad", 0.3), epochs=3, batch=20, key="id", shards=1, seed=9)
    keyed = df.select("id", *[F.xxhash64(F.lit(9), F.lit(e), "id").alias(f"e{e}") for e in range(3)]).collect()
    one_hot, xb = (y[:, None] == np.array(list("abc"))[None]).astype(float), np.hstack([x, np.ones((203, 1))])
    w, a = np.zeros((6, 3)), 0.0
    for e in range(3):
        order = [r.id for r in sorted(keyed, key=lambda r: (r[f"e{e}"], r.id))]
        for s in range(0, 203, 20):
            some = order[s : s + 20]
            g = xb[some].T @ linear.OBJECTIVES["log"](xb[some] @ w, one_hot[some])[1] / len(some)
            a = a + g * g
            w = w - 0.3 * g / (np.sqrt(a) + 1e-6)
    np.testing.assert_allclose(got.weights, w, rtol=1e-9)
    with pytest.raises(ValueError):
        linear.fit(df, "x", "label", list("abc"), batch=20)


def test_scores_of_null_features_are_null(spark):
    m = linear.Linear(np.array([[1.0, -1.0], [0.5, 0.0]]), ["p", "q"], "squared")
    got = m.scores(spark.createDataFrame([(1, [2.0]), (2, None), (3, [-1.0])], "id long, x array<double>"), "x").orderBy("id").collect()
    assert [r.scores for r in got] == [[2.5, -2.0], None, [-0.5, 1.0]]


def _sparse(seed=2, n=60, names=25):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, names)) * (r.random((n, names)) < 0.2)
    x[-1] = 0  # a row without features
    return x, [(i, f"f{j}", float(x[i, j])) for i in range(n) for j in range(names) if x[i, j]]


@pytest.mark.parametrize("objective, kind", [("log", "adagrad"), ("binary", "sgd"), ("squared", "adagrad"), ("absolute", "sgd"), ("binary_hinge", "adagrad")])
def test_wide_equals_numpy(spark, objective, kind):
    x, rows = _sparse()
    n, k, r = len(x), 2, np.random.default_rng(3)
    y = r.normal(size=(n, k)) if objective in ("squared", "absolute") else np.eye(k)[r.integers(0, k, n)]
    u = r.uniform(0.5, 2, n)
    features = spark.createDataFrame([*rows, (0, None, 1.0), (1, "f1x", None), (999, "f1", 5.0)], "id long, name string, value double")
    targets = spark.createDataFrame([(i, t.tolist(), float(w)) for i, (t, w) in enumerate(zip(y, u))], "id long, y array<double>, u double")
    m = wide.fit(features, targets, ["p", "q"], objective, kind, 0.3, 4, l2=0.01)
    w, b, a, c, losses = np.zeros((25, k)), np.zeros(k), np.zeros((25, k)), np.zeros(k), []
    seen = np.array([any(row[1] == f"f{j}" for row in rows) for j in range(25)])
    for _ in range(4):
        loss, g = linear.OBJECTIVES[objective](x @ w + b, y)
        losses.append((loss * u).sum() / u.sum())
        gw, gb = x.T @ (g * u[:, None]) / u.sum() + 0.01 * w, (g * u[:, None]).sum(axis=0) / u.sum()
        a, c = a + gw * gw, c + gb * gb
        w = w - 0.3 * (gw / (np.sqrt(a) + 1e-6) if kind == "adagrad" else gw)
        b = b - 0.3 * (gb / (np.sqrt(c) + 1e-6) if kind == "adagrad" else gb)
    got = {r.name: r.w for r in m.weights.collect()}
    assert set(got) == {f"f{j}" for j in np.flatnonzero(seen)}
    np.testing.assert_allclose([got[f"f{j}"] for j in np.flatnonzero(seen)], w[seen], atol=1e-9)
    np.testing.assert_allclose(m.bias, b, atol=1e-9)
    np.testing.assert_allclose(m.losses, losses, rtol=1e-9)
    ids = targets.select("id").unionByName(spark.createDataFrame([(999,)], "id long"))
    z = {r.id: r.z for r in m.raw(features, ids).collect()}
    np.testing.assert_allclose([z[i] for i in range(n)], x @ w + b, atol=1e-9)
    np.testing.assert_allclose(z[999], 5 * w[1] + b, atol=1e-9)


def test_wide_goes_on_from_a_model(spark):
    x, rows = _sparse(4)
    features = spark.createDataFrame(rows, "id long, name string, value double")
    targets = spark.createDataFrame([(i, "pq"[i % 2]) for i in range(len(x))], "id long, label string")
    t = wide.targets_of(targets, "id", "label", ["p", "q"])
    whole = wide.fit(features, t, ["p", "q"], kind="sgd", epochs=4)
    more = wide.fit(features, t, ["p", "q"], kind="sgd", epochs=2, start=wide.fit(features, t, ["p", "q"], kind="sgd", epochs=2))
    a, b = ({r.name: r.w for r in m.weights.collect()} for m in (whole, more))
    assert set(a) == set(b) and all(np.allclose(a[k], b[k]) for k in a)
    top = more.top_features(3).collect()
    assert len(top) == 6 and abs(top[0].weight) == max(abs(w[0]) for w in b.values())
    with pytest.raises(ValueError):
        wide.fit(features, t.where("id < 0"), ["p", "q"])


def test_wide_learns_a_million_features(spark):
    """Each row has features of its own, and one that tells the label; a parameter for each of 10^6 names."""
    n = 20_000
    ids = spark.range(n)
    own = ids.select("id", F.explode(F.sequence(F.col("id") * 50, F.col("id") * 50 + 49)).alias("name")).select("id", F.col("name").cast("string"), F.lit(0.1).alias("value"))
    tell = ids.select("id", F.concat(F.lit("tells "), F.col("id") % 2).alias("name"), F.lit(1.0).alias("value"))
    targets = wide.targets_of(ids.select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("label")), "id", "label", ["even", "odd"])
    features = own.unionByName(tell)
    m = wide.fit(features, targets, ["even", "odd"], epochs=2)
    assert m.weights.count() == 50 * n + 2 and m.losses[1] < m.losses[0]
    fresh = ids.select((F.col("id") + n).alias("id"), F.concat(F.lit("tells "), F.col("id") % 2).alias("name"), F.lit(1.0).alias("value"))
    assert m.predict(fresh).where((F.col("prediction") == "even") == (F.col("id") % 2 == 0)).count() == n


def _shuffled(spark):
    """Bytes of shuffle files on this machine."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in dirs for f in Path(d.getPath()).rglob("shuffle_*"))


def test_steps_leave_no_shuffle_files(spark):
    """Each step's shuffles go when its table is written, whether or not the driver collects garbage meanwhile."""
    features = spark.range(40_000).select((F.col("id") % 2000).alias("id"), F.concat(F.lit("t"), F.xxhash64("id").cast("string")).alias("name"), F.rand(1).alias("value"))
    targets = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"))
    before = _shuffled(spark)
    model = wide.fit(features, wide.targets_of(targets, "id", "label", ["a", "b"]), ["a", "b"], epochs=2)
    assert model.weights.count() == 40_000 and len(model.losses) == 2
    assert _shuffled(spark) - before < 1_000_000  # a step shuffles several MB; what is left are the rows of counts


def test_only_the_last_weights_stay(spark, monkeypatch):
    """Tables of earlier steps go; the last weights are read by the model."""
    made = []
    monkeypatch.setattr(wide, "Scratch", lambda s: made.append(Scratch(s)) or made[-1])
    features = spark.createDataFrame([(1, "p", 1.0), (2, "q", 2.0)], "id long, name string, value double")
    model = wide.fit(features, wide.targets_of(spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string"), "id", "label", ["a", "b"]), ["a", "b"], epochs=3)
    left = [p.name for p in Path(made[0].path.removeprefix("file:")).iterdir()]
    assert len(left) == 1 and left[0].startswith("weights")
    assert {r.id: r.prediction for r in model.predict(features).collect()} == {1: "a", 2: "b"}
