"""Factorisation machines, conditional random fields, kernel machines, HDBSCAN* and explanations, against plain versions and held-out accuracy."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from skarn.operators import crf, factorisation, kernel, lime, linear


def _slope(f, p, i, h=1e-6):
    up, down = p.copy(), p.copy()
    up[i] += h
    down[i] -= h
    return (f(up) - f(down)) / (2 * h)


def test_factorisation_gradient_and_scores():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(7, 4)), np.eye(3)[r.integers(0, 3, 7)]
    p = r.normal(size=3 + 12 + 3 * 4 * 2)
    bias, w, v = factorisation._split(p, 4, 3, 2)
    plain = [[bias[o] + row @ w[:, o] + sum(v[o][i] @ v[o][j] * row[i] * row[j] for i in range(4) for j in range(i + 1, 4)) for o in range(3)] for row in x]
    assert np.allclose(factorisation.scores(x, p, 3, 2), plain)
    loss = lambda q: linear.OBJECTIVES["log"](factorisation.scores(x, q, 3, 2), y)[0].sum()
    g = factorisation.gradient(x, linear.OBJECTIVES["log"](factorisation.scores(x, p, 3, 2), y)[1], p, 2)
    assert all(abs(g[i] - _slope(loss, p, i)) < 1e-4 for i in range(len(p)))


def test_factorisation_machine_learns_products(spark):
    """A label that only the product of two features tells."""
    r = np.random.default_rng(2)
    x = r.choice([-1.0, 1.0], size=(400, 4))
    rows = [(i, v.tolist(), "same" if v[0] * v[1] > 0 else "other") for i, v in enumerate(x)] + [(1000, None, "same"), (1001, [1.0, 1.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label string")
    m = factorisation.fit(df, "x", "label", ["other", "same"], factors=2, optimiser=linear.Optimiser("adam", 0.1), epochs=40)
    got = m.predict(df, "x").where("id < 1000").select("label", "prediction").collect()
    assert sum(g.label == g.prediction for g in got) > 390
    assert m.predict(df.where("id = 1000"), "x").first().prediction is None
    real = df.where("id < 1000").withColumn("y", F.array(F.get("x", F.lit(2)) * F.get("x", F.lit(3)) * 3))
    m = factorisation.fit(real, "x", "y", ["y"], "squared", factors=2, optimiser=linear.Optimiser("adam", 0.1), epochs=80)
    assert m.predict(real, "x").agg(F.avg(F.abs(F.get("y", F.lit(0)) - F.get("scores", F.lit(0))))).first()[0] < 0.5


def test_crf_against_all_labellings():
    r = np.random.default_rng(3)
    x, y, k = r.normal(size=(5, 2)), np.array([0, 2, 1, 1, 0]), 3
    p = r.normal(size=3 * k + k * k)
    w, moves = p[: 3 * k].reshape(3, k), p[3 * k :].reshape(k, k)
    local = np.hstack([x, np.ones((5, 1))]) @ w
    score = {s: local[np.arange(5), list(s)].sum() + sum(moves[a, b] for a, b in zip(s, s[1:])) for s in itertools.product(range(k), repeat=5)}
    total = np.log(sum(np.exp(v) for v in score.values()))
    found, single, _ = crf.chain_sums(local, moves)
    assert abs(found - total) < 1e-9
    assert abs(single[2, 1] - sum(np.exp(v - total) for s, v in score.items() if s[2] == 1)) < 1e-9
    assert tuple(crf.best_path(local, moves)) == max(score, key=score.get)
    loss, g = crf.loss_and_gradient(x, y, p, k)
    assert abs(loss - (total - score[tuple(y)])) < 1e-9
    assert all(abs(g[i] - _slope(lambda q: crf.loss_and_gradient(x, y, q, k)[0], p, i)) < 1e-4 for i in range(len(p)))


def test_crf_learns_what_follows_what(spark):
    """Labels alternate; the feature tells the first one alone."""
    r, rows = random.Random(4), []
    for i in range(60):
        first, n = r.randrange(2), r.randint(1, 8)
        for t in range(n):
            rows.append((i, t, [float(first) if t == 0 else 0.5], "ab"[(first + t) % 2]))
    df = crf.sequences_of(spark.createDataFrame(rows, "id long, t int, x array<double>, label string"), "id", ["t"], "x", "label")
    m = crf.fit(df, "xs", "labels", ["a", "b"], epochs=60)
    got = m.predict(df, "xs").collect()
    assert sum(g.prediction == g.labels for g in got) >= 58 and all(0 < c <= 1.000001 for g in got for c in g.confidence)
    assert m.predict(spark.createDataFrame([(1, None)], "id long, xs array<array<double>>"), "xs").first().prediction == []


def test_kernel_machine(spark):
    """A ring around a disc, which no line parts."""
    r = np.random.default_rng(5)
    angle, far = r.uniform(0, 7, 300), np.where(np.arange(300) % 2, 1.0, 3.0) + r.uniform(-0.3, 0.3, 300)
    df = spark.createDataFrame([(i, [float(f * np.cos(a)), float(f * np.sin(a))], "in" if i % 2 else "out") for i, (a, f) in enumerate(zip(angle, far))], "id long, x array<double>, label string")
    m = kernel.fit(df, "x", "label", ["in", "out"], "rbf", landmarks=40, gamma=0.5)
    assert m.predict(df, "x").where("label = prediction").count() > 290
    exact = kernel.KERNELS["rbf"](m.landmarks, m.landmarks, gamma=0.5)
    mapped = exact @ m.root
    assert np.allclose(mapped @ mapped.T, exact, atol=1e-6)


def test_going_on_from_a_model(spark):
    df = spark.createDataFrame([([float(i % 3), 1.0], "xyz"[i % 3]) for i in range(60)], "x array<double>, label string")
    whole = linear.fit(df, "x", "label", list("xyz"), optimiser=linear.Optimiser("sgd", 0.5), epochs=10)
    half = linear.fit(df, "x", "label", list("xyz"), optimiser=linear.Optimiser("sgd", 0.5), epochs=5)
    more = linear.fit(df, "x", "label", list("xyz"), optimiser=linear.Optimiser("sgd", 0.5), epochs=5, start=half)
    assert np.allclose(whole.weights, more.weights)


def test_explanations(spark):
    predict = lambda t: t.withColumn("y", F.when(F.col("text").contains("good"), 1.0).otherwise(0.0))
    found = lime.explain_text(predict, "a good day for it".split(), spark, k=1)
    assert max(found, key=lambda c: abs(found[c]) if c != "bias" else -1) == "1:good" and found["1:good"] > 0.8
    table = spark.createDataFrame([(["red", "blue", "green"][i % 3], float(i % 7), i) for i in range(210)], "colour string, size double, n int")
    predict = lambda t: t.withColumn("y", F.when(F.col("colour") == "red", 2.0).otherwise(0.0))
    found = lime.explain_columns(predict, table, {"colour": "red", "size": 3.0, "n": 5}, k=1)
    assert abs(found["colour"] - 2) < 0.1
