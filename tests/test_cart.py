"""Best-split trees against a search over all rows in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import cart
from skarn.operators.trees import one_hot

SCHEMA = "id long, v array<double>, y array<double>, w double"


def _impurity(y, w, kind):
    """Of all outputs together, times the weight."""
    m = (w[:, None] * y).sum(axis=0) / w.sum()
    if kind == "entropy":
        return -sum(w.sum() * p * np.log(p) for p in m if p > 1e-10)
    e = np.abs(y - m) if kind == "absolute" else (y - m) ** 2
    return (w[:, None] * e).sum() / y.shape[1]


def _plain(x, y, w, kind, depth, least=5.0, node=1, out=None):
    out = {} if out is None else out
    out[node] = (None, None, (w[:, None] * y).sum(axis=0) / w.sum())
    if depth == 0 or w.sum() < least:
        return out
    whole, best = _impurity(y, w, kind), (1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            left = x[:, f] <= a
            gain = whole - _impurity(y[left], w[left], kind) - _impurity(y[~left], w[~left], kind)
            if gain > best[0] + 1e-9:
                best = (gain, f, cut)
    if best[1] is not None:
        out[node] = (best[1], best[2], out[node][2])
        left = x[:, best[1]] <= best[2]
        for side, number in ((left, 2 * node), (~left, 2 * node + 1)):
            _plain(x[side], y[side], w[side], kind, depth - 1, least, number, out)
    return out


def _rows(spark, n=200, seed=1):
    r = np.random.default_rng(seed)
    x = np.stack([r.normal(size=n), r.integers(0, 4, n).astype(float), r.normal(size=n)], axis=1)
    y = np.stack([np.where(x[:, 0] > 0.3, 5.0, 1.0) + x[:, 1] + r.normal(size=n) / 5, 1e6 + 3 * (x[:, 2] > 0) + r.normal(size=n)], axis=1)
    w = r.integers(1, 4, n).astype(float)
    extra = [(900, None, [1.0, 1.0], 1.0), (901, [0.0, 0.0, 0.0], None, 1.0), (902, [9.0, 9.0, 9.0], [99.0, 99.0], 0.0)]
    return spark.createDataFrame([*((i, x[i].tolist(), y[i].tolist(), float(w[i])) for i in range(n)), *extra], SCHEMA).repartition(5), x, y, w


def _same(part, want, tree=0):
    for node, (f, cut, mean) in want.items():
        np.testing.assert_allclose(part.means[tree, node], mean, rtol=1e-9)
        assert (part.splits[tree, node][0] if f is not None else None) == (f if (tree, node) in part.splits else None)
        if f is not None:
            assert abs(part.splits[tree, node][1] - cut) < 1e-9
    assert {n for t, n in part.means if t == tree} == set(want)


@pytest.mark.parametrize("impurity", ["squared", "absolute"])
def test_joint_and_single_trees_equal_plain_search(spark, impurity):
    df, x, y, w = _rows(spark)
    joint = cart.fit(df, "v", "y", 3, 2, impurity, depth=3, weight="w")
    _same(joint.parts[0], _plain(x, y, w, impurity, 3))
    single = cart.fit(df, "v", "y", 3, 2, impurity, joint=False, depth=2, weight="w")
    for k in range(2):
        _same(single.parts[k], _plain(x, y[:, [k]], w, impurity, 2))
    got = {r.id: r.scores for r in single.predict(df, "v").collect()}
    assert got[900] is None and len(got[0]) == 2
    want, node = _plain(x, y[:, [0]], w, impurity, 2), 1
    while want[node][0] is not None:
        node = 2 * node + int(x[0, want[node][0]] > want[node][1])
    assert abs(got[0][0] - want[node][2][0]) < 1e-9


def test_entropy_tree_equals_plain_search(spark):
    _, x, y, _ = _rows(spark, 150, 4)
    label = np.where(x[:, 0] > 0, np.where(x[:, 1] > 1, "a", "b"), "c")
    df = spark.createDataFrame([(i, x[i].tolist(), str(label[i])) for i in range(150)], "id long, v array<double>, l string")
    df = df.withColumn("y", one_hot(F.col("l"), ["a", "b", "c"]))
    hot = np.stack([label == c for c in "abc"], axis=1).astype(float)
    model = cart.fit(df, "v", "y", 3, 3, "entropy", depth=3)
    _same(model.parts[0], _plain(x, hot, np.ones(150), "entropy", 3))
    assert model.predict(df, "v").where(F.array_position("scores", F.array_max("scores")) != F.array_position("y", F.lit(1.0))).count() == 0
    assert set(model.split_counts()) == {0, 1}


def test_many_values_make_quantile_bins_and_passes_agree(spark, monkeypatch):
    df, x, y, w = _rows(spark, 1000, 7)
    edges = cart.bin_edges(df.where("id < 900").withColumn("v", cart._dense("v", 3)), "v", 3, 16)
    assert len(edges[1]) == 4 and 10 < len(edges[0]) <= 16 and all(np.all(np.diff(e) > 0) for e in edges)
    coarse = cart.fit(df, "v", "y", 3, 2, "absolute", depth=3, bins=16, weight="w")
    monkeypatch.setattr(cart, "MOST_SENT", 1)  # a pass for each node
    again = cart.fit(df, "v", "y", 3, 2, "absolute", depth=3, bins=16, weight="w")
    assert coarse.parts[0].splits == again.parts[0].splits
    f, cut = coarse.parts[0].splits[0, 1]
    exact = _plain(x, y, w, "absolute", 1)[1]
    assert f == exact[0] and abs(cut - exact[1]) < 0.3


def test_forests_leaves_and_edges(spark):
    df, x, y, w = _rows(spark)
    forest = cart.fit(df, "v", "y", 3, 2, depth=4, members=8, key="id", fraction=0.7, bins=32, weight="w")
    one = cart.fit(df, "v", "y", 3, 2, depth=4, bins=32, weight="w")
    err = lambda m: m.predict(df.where("id < 900"), "v").agg(F.avg(F.abs(F.get("scores", F.lit(0)) - F.get("y", F.lit(0))))).first()[0]
    assert len({s for (t, n), s in forest.parts[0].splits.items() if n == 1}) > 1 and err(forest) < 1.0 and err(one) < 0.6
    stopped = cart.fit(df, "v", "y", 3, 2, depth=4, least_node=10_000, weight="w")
    assert not stopped.parts[0].splits
    heavy = cart.fit(df, "v", "y", 3, 2, depth=4, least_child=60, weight="w")
    assert heavy.parts[0].splits and len(heavy.parts[0].splits) <= 6
    same = spark.createDataFrame([(i, [1.0, None], [2.0, 3.0], 1.0) for i in range(9)], SCHEMA)
    flat = cart.fit(same, "v", "y", 3, 2)
    assert not flat.parts[0].splits and flat.predict(same, "v").first().scores == [2.0, 3.0]
    for bad in (lambda: cart.fit(same.where("id < 0"), "v", "y", 3, 2), lambda: cart.fit(same, "v", "y", 3, 2, "gini"), lambda: cart.fit(same, "v", "y", 3, 2, depth=11), lambda: cart.fit(same, "v", "y", 3, 2, members=2)):
        with pytest.raises(ValueError):
            bad()
