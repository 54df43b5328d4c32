"""Exact kernel machines against an online pass over single rows in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import dual_kernel
from skarn.operators.kernel import KERNELS

SCHEMA = "id long, v array<double>, label string, w double, x string, scores int"


def _plain(rows, outputs, kernel, orders, **options):
    """{id: dual weight}, learnt one row at a time."""
    alpha = {}
    for order in orders:
        for i in order:
            v, label, w = rows[i]
            z = np.zeros(len(outputs))
            for j, a in alpha.items():
                z[outputs.index(rows[j][1])] += a * KERNELS[kernel](np.array([v]), np.array([rows[j][0]]), **options)[0, 0]
            y = outputs.index(label)
            z[y] -= 1
            if z.argmax() != y:
                alpha[i] = alpha.get(i, 0) + w
    return alpha


def _rings(n=150):
    r = np.random.default_rng(5)
    angle, kind = r.uniform(0, 7, n), r.integers(0, 3, n)
    far = 1.0 + 1.5 * kind + r.uniform(-0.6, 0.6, n)
    return {i: ([float(f * np.cos(a)), float(f * np.sin(a))], "abc"[c], float(1 + i % 2)) for i, (a, f, c) in enumerate(zip(angle, far, kind))}


def _df(spark, rows):
    extra = [(1000, None, "a", 1.0), (1001, [1.0, None], "a", 1.0), (1002, [1.0, 1.0], None, 1.0), (1003, [1.0, 1.0], "z", 1.0), (None, [1.0, 1.0], "a", 1.0)]
    return spark.createDataFrame([(*r, "clash", 7) for r in [*((i, *x) for i, x in rows.items()), *extra]], SCHEMA).repartition(3)


def _order(epoch):
    return [F.md5(F.concat(F.lit(f"{epoch}:"), F.col("key").cast("string")))]


@pytest.mark.parametrize("block", [16, 64, 1000])
def test_equals_single_rows(spark, block):
    import hashlib

    rows, outputs = _rings(), ["a", "b", "c"]
    orders = [sorted(rows, key=lambda i: hashlib.md5(f"{e}:{i}".encode()).hexdigest()) for e in range(2)]
    want = _plain(rows, outputs, "rbf", orders, gamma=0.7)
    m = dual_kernel.fit(_df(spark, rows), "v", "label", outputs, "id", "rbf", 2, block, weight="w", order=_order, gamma=0.7)
    assert {r.key: r.alpha for r in m.support.collect()} == want and 10 < len(want) < 140
    got = {r.id: r for r in m.predict(_df(spark, rows).drop("scores"), "v").collect()}
    for i, (v, label, _) in rows.items():
        z = [sum(a * KERNELS["rbf"](np.array([v]), np.array([rows[j][0]]), gamma=0.7)[0, 0] for j, a in want.items() if rows[j][1] == o) for o in outputs]
        np.testing.assert_allclose(got[i].scores, z, rtol=1e-9, atol=1e-9)
        assert got[i].prediction == outputs[int(np.argmax(z))]
    assert got[1000].prediction is None and got[1001].scores is None and got[1003].prediction and got[None].prediction
    assert sum(got[i].prediction == label for i, (_, label, _) in rows.items()) > 130


def test_parts_of_the_support(spark, monkeypatch):
    """Scores added up over many parts of the support rows, with repeated rows and extra columns."""
    rows = _rings(60)
    df = _df(spark, rows).drop("scores")
    m = dual_kernel.fit(df, "v", "label", ["a", "b", "c"], "id", "polynomial", 2, 20, degree=2)
    want = {(r.id, r.prediction, tuple(np.round(r.scores or [], 6))) for r in m.predict(df, "v").where("id IS NOT NULL").collect()}
    monkeypatch.setattr(dual_kernel, "PART", 8 * 4 * 7)
    twice = m.predict(df.unionByName(df), "v", "id")
    assert {(r.id, r.prediction, tuple(np.round(r.scores or [], 6))) for r in twice.where("id IS NOT NULL").collect()} == want
    assert twice.count() == 2 * df.count()
    with pytest.raises(ValueError, match="key"):
        m.predict(df, "v")


def test_ties_repeats_and_errors(spark):
    row = (1, [1.0, 0.0], "a", 1.0, "", 1)
    m = dual_kernel.fit(spark.createDataFrame([row] * 5, SCHEMA), "v", "label", ["a", "b"], "id", "linear", 1, 2)
    # the first score is 0 less one, so the row is learnt from; after that a's 1 less one ties with b's 0, and a comes first
    assert [(r.key, r.alpha) for r in m.support.collect()] == [(1, 1.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert m.predict(none.drop("scores"), "v").count() == 0
    with pytest.raises(ValueError, match="no rows"):
        dual_kernel.fit(none, "v", "label", ["a"], "id")
    with pytest.raises(Exception, match="widths"):
        dual_kernel.fit(spark.createDataFrame([row, (2, [1.0], "b", 1.0, "", 1)], SCHEMA), "v", "label", ["a", "b"], "id")


def test_merged_tables(spark, monkeypatch):
    rows = _rings(60)
    want = dual_kernel.fit(_df(spark, rows), "v", "label", ["a", "b", "c"], "id", epochs=1, block=5)
    monkeypatch.setattr(dual_kernel, "TABLES", 3)
    got = dual_kernel.fit(_df(spark, rows), "v", "label", ["a", "b", "c"], "id", epochs=1, block=5)
    assert {tuple(r) for r in got.support.select("key", "alpha").collect()} == {tuple(r) for r in want.support.select("key", "alpha").collect()}


@pytest.mark.parametrize("kernel, options", [("polynomial", dict(degree=2)), ("polynomial", dict(degree=3, gamma=2.0, coefficient=0.0)), ("linear", {})])
def test_monomials_are_the_kernel(kernel, options, monkeypatch):
    monkeypatch.setattr(dual_kernel, "SUPPORT", 1)
    r = np.random.default_rng(3)
    x, s, y, alpha = r.normal(0, 1, (20, 4)), r.normal(0, 1, (30, 4)), r.integers(0, 3, 30), r.uniform(0, 2, 30)
    m = dual_kernel.Monomials.find(kernel, 4, 3, 100, options)
    np.testing.assert_allclose(m.scores(x, m.weights(s, y, alpha, 3)), dual_kernel._scores(x, s, y, alpha, 3, kernel, options), rtol=1e-9, atol=1e-9)
    for other in ((kernel, 4, 3, 10 if kernel == "polynomial" else 4, options), (kernel, 4000, 300, 1 << 40, options | {"degree": 2}), ("polynomial", 4, 3, 100, {"degree": 1.5}), ("rbf", 4, 3, 100, {})):
        assert dual_kernel.Monomials.find(*other) is None


@pytest.mark.parametrize("block, chain", [(16, 3), (1000, 64)])
def test_monomials_learn_what_support_rows_learn(spark, monkeypatch, block, chain):
    """Whole numbers: the same dual weights and scores to the last bit, with as many jobs as chains of blocks, not as blocks."""
    rows = {i: ([float(np.floor(4 * c)) for c in v], label, w) for i, (v, label, w) in _rings().items()}
    df = _df(spark, rows).drop("scores")
    fitted = lambda: dual_kernel.fit(df, "v", "label", ["a", "b", "c"], "id", "polynomial", 2, block, weight="w", order=_order, degree=2)
    told = lambda m: ({(r.key, r.alpha) for r in m.support.collect()}, {(r.id, r.prediction, tuple(r.scores or [])) for r in m.predict(df, "v").collect()})
    want = told(fitted())
    monkeypatch.setattr(dual_kernel, "SUPPORT", 10)
    monkeypatch.setattr(dual_kernel, "CHAIN", chain)
    monkeypatch.setattr(dual_kernel, "TABLES", 3)
    assert told(fitted()) == want and 10 < len(want[0]) < 150
