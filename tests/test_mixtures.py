"""Gaussian mixtures against plain numpy."""

import numpy as np
import pytest

from skarn.operators import mixtures

SCHEMA = "id long, v array<double>"


def _rows(spark, seed=1):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 150), r.multivariate_normal([6, 0], [[0.2, 0], [0, 2]], 100), r.multivariate_normal([0, 9], [[1, 0], [0, 1]], 50)])
    return spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (999, None)], SCHEMA).repartition(5), x


def _plain(x, means, kind, rounds, jitter=1e-6):
    n, d = x.shape
    k = len(means)
    share, cov = np.full(k, 1 / k), [np.eye(d) for _ in range(k)]
    for _ in range(rounds):
        p = np.array([s * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for s, m, c in zip(share, means, cov)]).T
        r = p / p.sum(axis=1, keepdims=True)
        share = r.mean(axis=0)
        means = [r[:, j] @ x / r[:, j].sum() for j in range(k)]
        cov = [((x - means[j]) * r[:, [j]]).T @ (x - means[j]) / r[:, j].sum() for j in range(k)]
        cov = [{"full": c, "diagonal": np.diag(np.diag(c)), "spherical": np.eye(d) * np.diag(c).mean()}[kind] + jitter * np.eye(d) for c in cov]
    return share, np.array(means), cov


@pytest.mark.parametrize("kind", mixtures.KINDS)
def test_rounds_equal_numpy(spark, kind):
    df, x = _rows(spark)
    start = np.array([[1.0, 1.0], [5.0, 1.0], [1.0, 7.0]])
    m = mixtures.fit(df, "v", 3, kind, rounds=4, least_gain=-np.inf, means=start)
    share, means, cov = _plain(x, start, kind, 4)
    np.testing.assert_allclose(m.shares, share, rtol=1e-8)
    np.testing.assert_allclose(m.means, means, atol=1e-8)
    got = [c if kind == "full" else np.diag(np.broadcast_to(c, 2)) for c in m.covariances]
    np.testing.assert_allclose(got, cov, atol=1e-7)
    assert all(b >= a for a, b in zip(m.likelihoods, m.likelihoods[1:]))


def test_finds_the_groups_from_a_seed(spark):
    df, x = _rows(spark)
    m = mixtures.fit(df, "v", 3, "full", key="id", seed=3)
    out = {r.id: r for r in m.predict(df, "id", "v").collect()}
    assert len(out) == 300 and all(abs(sum(r.responsibilities) - 1) < 1e-9 for r in out.values())
    groups = [{out[i].cluster for i in part} for part in (range(150), range(150, 250), range(250, 300))]
    majority = [max(g, key=lambda c: sum(out[i].cluster == c for i in part)) for g, part in zip(groups, (range(150), range(150, 250), range(250, 300)))]
    assert len(set(majority)) == 3
    right = sum(out[i].cluster == majority[j] for j, part in enumerate((range(150), range(150, 250), range(250, 300))) for i in part)
    assert right > 290
    far = m.predict(spark.createDataFrame([(1, [1e6, -1e6])], SCHEMA), "id", "v").first()  # no density vanishes in logarithms
    assert np.isfinite(far.log_density) and abs(sum(far.responsibilities) - 1) < 1e-9


def test_mixture_edges(spark):
    same = spark.createDataFrame([(i, [2.0, 3.0]) for i in range(9)], SCHEMA)
    m = mixtures.fit(same, "v", 4, key="id")
    assert len(m.means) == 1 and m.means[0].tolist() == [2.0, 3.0]  # fewer distinct vectors than components
    lost = mixtures.fit(same, "v", 2, rounds=3, means=np.array([[2.0, 3.0], [1e9, 1e9]]))
    assert lost.shares[1] == 0 and np.isfinite(lost.likelihoods).all()
    for bad in (lambda: mixtures.fit(same.where("id < 0"), "v", 2, key="id"), lambda: mixtures.fit(same, "v", 2, "other"), lambda: mixtures.fit(same, "v", 2)):
        with pytest.raises(ValueError):
            bad()
