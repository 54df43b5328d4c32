"""Values of all pairs in tasks of blocks, against plain numpy."""

import numpy as np
import pytest

from skarn.operators import pairwise
from skarn.plans import model_queries

SCHEMA = "vec_id long, embedding array<float>"


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_pairs_of_odd_vectors(spark, monkeypatch):
    """Null ids, null vectors, nulls inside, different and no lengths, vectors of zeros; blocks smaller than a batch."""
    monkeypatch.setattr(pairwise, "BLOCK", 7)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 1, 4).astype(np.float32).tolist()) for i in range(40)]
    rows += [(40, None), (41, [1.0, None, 2.0, 0.0]), (42, [1.0, 2.0]), (43, []), (44, [0.0] * 4), (None, [1.0] * 4), (45, [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(t.a, t.b): (t.l1, t.l2, t.cosine) for t in pairwise.pairs(df.where("vec_id % 2 = 0 OR vec_id > 39"), df, ["l1", "l2", "cosine"], model_queries._distances).collect()}
    of = {i: v for i, v in rows if i is not None}
    assert set(got) == {(a, b) for a in of if a % 2 == 0 or a > 39 for b in of}
    for (a, b), found in got.items():
        x, y = of[a], of[b]
        if x is None or y is None or None in x or None in y or len(x) != len(y):
            assert found == (None, None, None)
            continue
        x, y = np.array(x), np.array(y)
        cosine = x @ y / np.sqrt(x @ x * (y @ y)) if x @ y else 0.0
        np.testing.assert_allclose(found, [round(np.abs(x - y).sum(), 6), round(np.sqrt(((x - y) ** 2).sum()), 6), round(1 - cosine, 6)], atol=1.1e-6)


def test_rounding():
    x = np.array([0.5e-6, -0.5e-6, 1.4e-6, -0.1e-6, np.inf, 1e305, 2.5])
    got = pairwise.rounded(x, 6)
    assert got.tolist() == [1e-6, -1e-6, 1e-6, 0.0, np.inf, 1e305, 2.5] and not np.signbit(got[3])
    assert np.isnan(pairwise.rounded(np.array([np.nan]), 6))[0]


@pytest.mark.parametrize("name", ["distances", "kernels"])
def test_queries_run_in_many_tasks_over_blocks(spark, tmp_path, name):
    """One file of one piece was one task that went through the pairs row by row."""
    rows = [(i, [float(i), 1.0]) for i in range(3000)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = getattr(model_queries, name)(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 8 and "CartesianProduct" in _nodes(found) and "Generate" not in _nodes(found)
    assert found.count() == 60 * 3000


def test_kernels_of_vectors():
    r = np.random.default_rng(2)
    x, y = r.normal(0, 1, (5, 6)), r.normal(0, 1, (9, 6))
    linear, poly, rbf, sigmoid = model_queries._kernels(x, y)
    for i in range(5):
        for j in range(9):
            d, q = x[i] @ y[j], ((x[i] - y[j]) ** 2).sum()
            np.testing.assert_allclose([linear[i, j], poly[i, j], rbf[i, j], sigmoid[i, j]], [round(d, 6), round((0.5 * d + 1) ** 2, 5), round(np.exp(-0.1 * q), 6), round(np.tanh(0.1 * d), 6)], atol=1.1e-5)
