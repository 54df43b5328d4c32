"""Quality, whitening and annulus clustering against brute force, and over nulls, empty and odd rows, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import clustering, quality, queries, whitening
from skarn.llm.common import folded, written

VECS = "vec_id long, embedding array<double>, label int, v string, n int, cluster string"


def _shares(text):
    """The features of one text, by Python alone."""
    text = text or ""
    kinds = [quality.END, *map(quality._kind, text), quality.END]
    pairs = Counter(zip(kinds, kinds[1:]))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, k = len(text), max(len(words), 1)
    count, two = Counter(words), Counter(zip(words, words[1:]))
    shares = [pairs[a, b] / (n + 1) for a in range(quality.KINDS) for b in range(quality.KINDS)]
    letters, n_two = sum(map(len, words)), max(sum(two.values()), 1)
    return [*shares, np.log1p(n), np.log1p(len(words)), letters / k, len(count) / k, max(count.values(), default=0) / k, len(two) / n_two, max(two.values(), default=0) / n_two,
            np.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), np.log1p(max(map(len, lines), default=0)), np.log1p(letters / k)]


def test_describe_equals_python():
    r = random.Random(1)
    texts = ["".join(r.choice("ab Z9.,#\n é日\U0001f600") for _ in range(r.randrange(0, 200))) for _ in range(300)]
    texts += [None, "", " ", "\n\n", "a", "a a a b", "x\n\nx\ny", "#" * 5000, "word " * 4000, "\0a\0", "\ud800 lone"]
    got = quality.describe(texts)
    assert got.shape == (len(texts), quality.N_FEATURES)
    np.testing.assert_allclose(got, np.array([_shares(t) for t in texts]), atol=1e-5)
    assert quality.describe([]).shape == (0, quality.N_FEATURES)


def _corpus(n, seed, junk=0.2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioutnsrl") for _ in range(r.randint(2, 8)))
    out = []
    for i in range(n):
        if r.random() < junk:
            out.append((i, r.choice([" | ".join(word() for _ in range(40)), "BUY!! " * r.randint(10, 60), "".join(r.choice("#$%& x") for _ in range(200))]), 0))
        else:
            out.append((i, " ".join(word().capitalize() + " " + " ".join(word() for _ in range(r.randint(4, 12))) + "." for _ in range(r.randint(2, 20))), 1))
    return out


def test_quality_learns_from_positives_alone(spark):
    rows = _corpus(1500, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    trusted = [i for i, _, y in rows if y and i % 5 and i % 3]
    form = written(quality.features(docs), "f")
    model = quality.fit(form, spark.createDataFrame([(i,) for i in trusted], "doc_id long"))
    truth = sum(y for *_, y in rows) / len(rows)
    assert abs(model.prior - truth) < 0.08
    got = {r.doc_id: r.score for r in quality.score(form, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.3) == bool(y) for i, _, y in rows if i % 5 == 0]
    assert sum(right) / len(right) > 0.97
    given = quality.fit(form, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), prior=truth)
    assert given.prior == truth and len(given.risks) <= 15


def test_quality_risk_is_what_the_formula_says(spark):
    """The sums of a pass give the two parts of the risk as plain numpy does."""
    rows = _corpus(200, 4)
    form = written(quality.features(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")), "f")
    positives = spark.createDataFrame([(i,) for i, _, y in rows if y and i % 2], "doc_id long")
    model = quality.fit(form, positives, prior=0.8, rounds=1)
    x = quality.expand(quality.describe([t for _, t, _ in rows]).astype(float), model.mean, model.sd)
    p = x[[i for i, _, y in rows if y and i % 2]]
    assert model.risks[0] == pytest.approx((0.8 * np.log(2), np.log(2) - 0.8 * np.log(2)), rel=1e-9)
    w = np.linspace(-0.1, 0.1, x.shape[1])
    train = form.select("f", F.lit(0).alias("side")).unionByName(form.join(positives, "doc_id", "left_semi").select("f", F.lit(1).alias("side")))
    s = quality._gather(train, model.mean, model.sd, w)
    soft = lambda z: np.logaddexp(0, z).sum()
    np.testing.assert_allclose([*s.count, *s.plus, *s.minus], [len(x), len(p), soft(-x @ w), soft(-p @ w), soft(x @ w), soft(p @ w)], rtol=1e-5)
    sig = 1 / (1 + np.exp(-x @ w))
    np.testing.assert_allclose(s.hessian, (x * (sig * (1 - sig))[:, None]).T @ x, rtol=1e-3, atol=1e-4)


def test_quality_steps_back_where_negatives_cost_less_than_nothing(spark):
    """With too high a prior the unbiased risk falls without end; the kept weights have a cost of negatives near zero or above."""
    rows = _corpus(300, 5, junk=0.5)
    form = written(quality.features(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")), "f")
    model = quality.fit(form, spark.createDataFrame([(i,) for i, _, y in rows if y and i % 2], "doc_id long"), prior=0.95, rounds=12)
    assert min(n for _, n in model.risks) < 0  # the step was taken back
    assert any(b > a for (_, a), (_, b) in zip(model.risks, model.risks[1:]) if a < 0)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "Good text here.", "f", 1), (1, "Good text here.", "f", 1), (2, None, "g", 2), (3, "", "h", 3), (None, "## $$", "i", 4), (5, "x" * 300_000, "j", 5)], "doc_id long, text string, f string, side int")
    trusted = spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id long")
    got = quality.classify(docs, trusted).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 5), (True, 0)]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1 and len({r.score for r in got if r.doc_id == 1}) == 1
    none = quality.classify(docs, trusted.where("doc_id = 77")).collect()
    assert [(r.score, r.predicted) for r in none] == [(0.5, 1)] * 6
    assert quality.classify(docs.where("doc_id = 99"), trusted).count() == 0


def test_quality_query(spark, sf):
    got = {r.doc_id: r for r in queries.quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    right = [got[i].predicted == q for i, q in labels.items() if got[i].held_out]
    assert sum(right) / len(right) > 0.85  # 19 rows


def test_folded_sums_in_the_order_of_partitions(spark):
    df = spark.range(1000).repartition(150)
    one = lambda batches: (np.array([sum(sum(b.column("id").to_pylist()) for b in batches), 1.0]) for _ in range(1))
    assert folded(df, one, np.add, np.zeros(2)).tolist() == [499500.0, 150.0]
    assert folded(spark.createDataFrame([], "id long"), lambda batches: iter(()), np.add, np.zeros(2)).tolist() == [0.0, 0.0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_symmetric_qr(n):
    a = np.random.default_rng(n).normal(size=(n, n))
    for m in (a @ a.T, a + a.T, np.ones((n, n)), np.zeros((n, n)), np.diag(np.arange(n) // 2 * 1.0)):
        d, v = whitening.symmetric_qr(m)
        np.testing.assert_allclose(d, np.linalg.eigvalsh(m)[::-1], atol=1e-11 * max(1, np.abs(m).max()) * n)
        np.testing.assert_allclose(v.T @ v, np.eye(n), atol=1e-13 * n)
        np.testing.assert_allclose(m @ v, v * d, atol=1e-12 * max(1, np.abs(m).max()) * n)


def test_moments_merge_as_one_stream():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 6)) * 10 + 1e6
    whole_, parts = whitening.Moments.nothing(6), [whitening.Moments.nothing(6) for _ in range(4)]
    for i, row in enumerate(x):
        whole_.add(row)
        parts[i % 3].add(row)
    merged = parts[0].merge(parts[3]).merge(parts[1]).merge(parts[2])
    assert merged.n == whole_.n == 500
    np.testing.assert_allclose(merged.covariance(), np.cov(x.T, bias=True), rtol=1e-9)
    np.testing.assert_allclose(whole_.covariance(), np.cov(x.T, bias=True), rtol=1e-9)
    kept = whitening.Moments.of(whitening.Moments(3, [2**75, -(2**66) - 1], np.ones(2), np.eye(2)).vector(), 2)
    assert kept.n == 3 and kept.sums == [2**75, -(2**66) - 1]


def _vectors(spark, n=200, d=12, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * np.linspace(0.5, 3, d) @ np.linalg.qr(r.normal(size=(d, d)))[0]
    rows = [(i, [float(c) for c in v], 0, "x", 1, "y") for i, v in enumerate(x)]
    odd = [(500, None, 0, "", 0, ""), (501, [], 0, "", 0, ""), (502, [1.0, None, *[0.0] * (d - 2)], 0, "", 0, ""), (503, [float("nan")] * d, 0, "", 0, ""), (504, [float("-inf"), *[0.0] * (d - 1)], 0, "", 0, "")]
    again = [rows[3], rows[3], (None, rows[4][1], 0, "", 0, "")]
    return spark.createDataFrame(rows + odd + again, VECS), [(i, v) for i, v, *_ in rows + again]


def test_whitening_equals_numpy(spark):
    df, rows = _vectors(spark)
    got = whitening.whiten(df.repartition(5), components=7).toPandas()
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    cov = c.T @ c / n
    e, basis = (y[..., ::-1][..., :7] for y in np.linalg.eigh(cov))
    want = c @ basis / np.sqrt(e)
    assert len(got) == 7 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    wide = got[got.vec_id.notna() & (got.vec_id != 3)].pivot(index="vec_id", columns="component", values="whitened")
    at = [i for i, (k, _) in enumerate(rows) if k is not None and k != 3]
    signs = np.sign((wide.to_numpy() * want[at]).sum(axis=0))
    np.testing.assert_allclose(wide.to_numpy() * signs, want[at], atol=1e-9)
    np.testing.assert_allclose(got.groupby("component").explained.first(), e / np.trace(cov), rtol=1e-9)
    assert (got.vec_id == 3).sum() == 21 and got.vec_id.isna().sum() == 7
    exact = {k: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for (k, _), row in zip(rows, x)}
    assert all(exact[k] == d for k, d in zip(got.vec_id.dropna().astype(int), got.deviation[got.vec_id.notna()]))


def test_whitening_edges(spark):
    assert whitening.whiten(spark.createDataFrame([], VECS)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0  # no variance, no component
    flat = spark.createDataFrame([(i, [float(i), 2.0, 7.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(flat).collect()
    assert len(got) == 5 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
    mixed = spark.createDataFrame([(i, [float(i % 3), float(i % 2)] if i % 2 else [float(i), 1.0 / (i + 1), float(i * i % 7)]) for i in range(20)], "vec_id long, embedding array<float>")
    got = whitening.whiten(mixed).toPandas()
    assert set(got.n) == {10} and got.groupby("vec_id").size().to_dict() == {i: 1 if i % 2 else 3 for i in range(20)}
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 3.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(huge).collect()
    assert {r.deviation for r in got if r.vec_id == 1} == {(1 << 63) - 1} and all(np.isfinite(r.whitened) for r in got)


def _lloyd(rows, k, rounds, dim):
    """Plain k-means in Python's whole numbers."""
    rows = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) for c in v] for _, v in rows]
    key = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    first = sorted(range(len(rows)), key=lambda j: (key(rows[j][0]), rows[j][1]))[:k]
    c = [x[j] for j in first]
    for nth in range(rounds + 1):
        at = [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for v in x]
        if nth < rounds:
            for j in range(len(c)):
                own = [v for v, (_, o) in zip(x, at) if o == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own)]
    inertia = Counter()
    for d, j in at:
        inertia[j] += d
    most = (1 << 63) - 1
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i is None, i or 0), j, min(most, d), min(most, inertia[j]), min(most, sum(inertia.values())), sha[j]) for (i, _), (d, j) in zip(rows, at))


def _clustered(df, **options):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clustering.cluster(df, **options).collect())


@pytest.mark.parametrize("kind", ["spread", "ties", "huge", "few"])
def test_clustering_equals_lloyd(spark, kind):
    r, d = np.random.default_rng(7), 4
    n = 3 if kind == "few" else 150
    x = r.normal(size=(n, d)) * (r.integers(1, 9, size=(n, 1)))
    x = {"spread": x, "few": x, "ties": np.round(x) % 2, "huge": x * 1e14}[kind]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [rows[0], rows[0], (None, rows[1][1]), (900, None), (901, [1.0] * (d + 1)), (902, [None] * d), (903, [float("inf")] * d), (904, [])]
    df = spark.createDataFrame([(i, v, 0, "v", 1, "c") for i, v in rows], VECS)
    assert _clustered(df.repartition(3), k=5, rounds=4, dim=d) == _lloyd(rows, 5, 4, d)


def test_clustering_edges(spark):
    empty = clustering.cluster(spark.createDataFrame([], VECS))
    assert empty.count() == 0 and empty.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    floats = spark.createDataFrame([(i, [i / 3, -i / 7]) for i in range(9)], "vec_id long, embedding array<float>")
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in floats.collect()]
    assert _clustered(floats, k=3, rounds=2, dim=2) == _lloyd(rows, 3, 2, 2)


def test_annulus_compares_few_and_keeps_boundary_ties():
    """On rings of many norms nearly all centroids fall outside the annulus; two at the same distance on its edge are both compared."""
    r = np.random.default_rng(5)
    turn = r.uniform(0, 2 * np.pi, 400)
    c = np.floor(np.column_stack([np.cos(turn), np.sin(turn)]) * np.linspace(100, 1e6, 400)[:, None])
    x = np.floor(c[r.integers(0, 400, 1000)] + r.normal(size=(1000, 2)) * 50)
    d = ((x[:, None].astype(int) - c[None].astype(int)) ** 2).sum(axis=2)
    number, best, done = clustering.Centroids(c).nearest(x, d.argsort(axis=1)[:, 1].astype(np.int32))
    assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert done.mean() < 40
    edge = clustering.Centroids(np.array([[20.0, 0.0], [0.0, 0.0], [0.0, 0.0]]))  # 10 away from all three
    number, best, _ = edge.nearest(np.array([[10.0, 0.0]]), np.array([2]))
    assert number.tolist() == [0] and best.tolist() == [100]
