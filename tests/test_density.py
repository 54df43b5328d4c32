"""The metric index and HDBSCAN* against plain Python, ties and repeated points included."""

import numpy as np
import pytest

from skarn.operators import hdbscan, neighbours
from skarn.operators.scratch import Scratch

SCHEMA = "vec_id long, embedding array<double>"


def _plain(ids, v, least, k):
    """{id: (cluster, score)} by Prim's tree and a hierarchy cut from the top, all edges of a weight at once."""
    n = len(v)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, k - 1] if k > 1 else np.zeros(n)
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    best, link, inside, edges = reach[0].copy(), np.zeros(n, int), {0}, []
    for _ in range(n - 1):
        j = min((x for x in range(n) if x not in inside), key=lambda x: best[x])
        edges.append((best[j], link[j], j))
        inside.add(j)
        better = reach[j] < best
        best[better], link[better] = reach[j][better], j
    inverse = lambda w: 1 / max(w, 1e-300)
    eps, last, tree = {}, {}, []  # a cluster: [parent, born, points, stability, died, kids]

    def grow(parent, born, points):
        tree.append([parent, born, sorted(points), 0.0, None, []])
        if parent is not None:
            tree[parent][5].append(len(tree) - 1)
        return len(tree) - 1

    queue = [grow(None, np.inf, range(n))]
    while queue:
        c = queue.pop()
        points, base = set(tree[c][2]), 0.0 if np.isinf(tree[c][1]) else inverse(tree[c][1])
        while points:
            own = [e for e in edges if e[1] in points and e[2] in points]
            if not own:
                break
            w = max(e[0] for e in own)
            left, parts = set(points), []
            while left:
                part, stack = set(), [left.pop()]
                while stack:
                    x = stack.pop()
                    part.add(x)
                    near = {y for e in own if e[0] < w and x in e[1:] for y in e[1:]} - part
                    left -= near
                    stack += near
                parts.append(part)
            big = [p for p in parts if len(p) >= least]
            for p in parts:
                if len(p) < least:
                    for x in p:
                        eps[x], last[x] = w, c
                        tree[c][3] += inverse(w) - base
            if len(big) == 1:
                points = big[0]
                continue
            tree[c][4] = w
            for p in big:
                tree[c][3] += len(p) * (inverse(w) - base)
                queue.append(grow(c, w, p))
            break
    value, deepest, chosen = {}, {}, set()
    for c in range(len(tree) - 1, -1, -1):
        kids = tree[c][5]
        below = sum(value[x] for x in kids)
        value[c] = max(tree[c][3], below) if kids else tree[c][3]
        deepest[c] = min(deepest[x] for x in kids) if kids else tree[c][4]
        if c and (not kids or tree[c][3] >= below):
            chosen.add(c)
    label = {}
    for c in range(len(tree)):  # parents first
        above = label.get(tree[c][0])
        label[c] = above if above is not None else c if c in chosen else None
    of = {x: label[last[x]] for x in range(n)}
    names = {c: i + 1 for i, c in enumerate(sorted({c for c in of.values() if c is not None}, key=lambda c: min(ids[x] for x in of if of[x] == c)))}
    return {ids[x]: (names.get(of[x], 0), 1 - deepest[last[x]] / eps[x] if eps[x] else 0.0) for x in range(n)}


def _points(kind):
    r = np.random.default_rng(3)
    if kind == "clusters":
        return np.concatenate([r.normal(0, 0.3, (40, 3)), r.normal(4, 0.5, (50, 3)), r.normal((0, 6, 0), 1.0, (40, 3)), r.uniform(-4, 9, (15, 3))])
    if kind == "grid":  # nearly all weights are ties
        return np.concatenate([np.round(r.normal(0, 1.5, (60, 2))), np.round(r.normal(12, 1.5, (50, 2))), [[30.0, 30.0]]])
    if kind == "repeats":
        return np.repeat(r.normal(0, 5, (12, 2)), 6, axis=0)
    return np.cumsum(r.uniform(0.5, 2.0, 60))[:, None] * [1.0, 0.0]  # a chain


@pytest.mark.parametrize("kind, least, k, block", [("clusters", 9, 4, 16), ("grid", 4, 4, 16), ("repeats", 4, 3, 2048), ("chain", 3, 1, 8)])
def test_hdbscan_equals_plain_python(spark, monkeypatch, kind, least, k, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(hdbscan, "NEAR", 3)  # so that candidates don't suffice
    v = _points(kind)
    ids = np.random.default_rng(1).permutation(1000)[: len(v)].tolist()
    df = spark.createDataFrame([*zip(ids, v.tolist()), (5000, None), (None, v[0].tolist())], SCHEMA).repartition(3)
    got = {r.id: (r.cluster, r.outlier_score) for r in hdbscan.hdbscan(df, least, k).collect()}
    want = _plain(ids, v, least, k)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    np.testing.assert_allclose([got[i][1] for i in ids], [want[i][1] for i in ids], atol=1e-9)


def test_hdbscan_edges(spark):
    none = hdbscan.fit(spark.createDataFrame([], SCHEMA))
    assert none.assigned.count() == 0
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0])], SCHEMA)
    model = hdbscan.fit(few, 5)
    assert sorted(tuple(r) for r in model.assigned.collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
    assert [(r.cluster, r.outlier_score) for r in model.predict(few).collect()] == [(0, hdbscan.NOISE_SCORE)] * 2
    with pytest.raises(ValueError):
        hdbscan.fit(few, 1)


def test_prediction_by_exemplars(spark):
    """Probes near a cluster get its number and the score of the nearest exemplar; those that no exemplar reaches are noise with the greatest noise score."""
    v = _points("clusters")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)
    model = hdbscan.fit(df, 5)
    of = {r.id: (r.cluster, r.outlier_score) for r in model.assigned.collect()}
    x = model.exemplars
    sizes = {c: sum(1 for o, _ in of.values() if o == c) for c in {o for o, _ in of.values()}}
    total = int((len(v) / 2) ** 0.5) + len(sizes)
    for c in set(x.clusters.tolist()):
        own = x.clusters == c
        assert own.sum() == max(1, sizes[c] * total // len(v))
        scores = sorted({s for o, s in of.values() if o == c})
        assert x.scores[own].tolist() == scores[: own.sum()]
        rest = [max(i for i in of if of[i] == (c, s)) for s in scores[own.sum() :]]
        far = np.sqrt(((x.vectors[own][:, None] - v[rest][None]) ** 2).sum(axis=2)).max(axis=1)
        np.testing.assert_allclose(x.reach[own], far)
    noise = max(s for c, s in of.values() if c == 0)
    assert model.noise_score == noise
    probes = np.concatenate([v[:3] + 0.01, v[50:53] + 0.01, [[50.0, 50.0, 50.0], [-40.0, 0.0, 0.0]]])
    got = {r.probe: (r.cluster, r.outlier_score) for r in hdbscan.predict(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(probes)], SCHEMA), model).collect()}
    d = np.sqrt(((probes[:, None] - x.vectors[None]) ** 2).sum(axis=2))
    want = {i: (int(x.clusters[row.argmin()]), x.scores[row.argmin()]) if (row <= x.reach).any() else (0, noise) for i, row in enumerate(d)}
    assert got == want and got[6] == got[7] == (0, noise) and got[0][0] == of[0][0] != 0


def test_alike_points_have_exemplars_of_few_scores(spark):
    """Where a cluster has fewer distinct scores than exemplars, others of it fill up."""
    v = _points("repeats")
    model = hdbscan.fit(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA), 4, 3)
    n = {c: int((model.exemplars.clusters == c).sum()) for c in set(model.exemplars.clusters.tolist())}
    sizes = {r["cluster"]: r["count"] for r in model.assigned.groupBy("cluster").count().collect()}
    total = int((len(v) / 2) ** 0.5) + len(sizes)
    assert n == {c: max(1, s * total // len(v)) for c, s in sizes.items() if c}


@pytest.mark.parametrize("distance", ["L1", "L2", "COSINE"])
def test_index_finds_what_brute_force_finds(spark, monkeypatch, distance):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    r = np.random.default_rng(2)
    x = np.concatenate([np.round(r.normal(0, 2, (70, 2))), np.zeros((5, 2)), r.normal(20, 1, (40, 2))])
    q = np.concatenate([x[::7], r.normal(5, 9, (10, 2))])
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)] + [(None, [0.0, 0.0]), (999, None)], SCHEMA)
    probes = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(q)], SCHEMA)
    d = neighbours._distances(q, x, distance)
    want = {(i, n + 1, int(j), row[j]) for i, row in enumerate(d) for n, j in enumerate(np.lexsort((np.arange(len(x)), row))[:6])}
    got = {tuple(t) for t in neighbours.k_nearest(probes, points, 6, distance=distance).collect()}
    if distance == "COSINE":  # last digits depend on how many rows are multiplied at once, and so do ties
        got, want = ({(p, n, round(far, 10)) for p, n, _, far in s} for s in (got, want))
    assert got == want
    assert neighbours.k_nearest(probes, points, 500).count() == len(q) * len(x)  # more than there are
    assert neighbours.k_nearest(probes, points.where("vec_id < 0"), 3).count() == 0 == neighbours.k_nearest(probes.where("vec_id < 0"), points, 3).count()


def test_index_leaves_out_most_blocks_of_clustered_points(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    r = np.random.default_rng(4)
    centres = r.uniform(-100, 100, (40, 4))
    x = centres[r.integers(0, 40, 4000)] + r.normal(0, 0.5, (4000, 4))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], SCHEMA)
    stats: dict = {}
    near = neighbours.k_nearest(df, df, 5, stats=stats)
    got = {}
    for t in near.collect():
        got.setdefault(t.probe, []).append((t["rank"], t.neighbour))
    for i in range(0, 4000, 97):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert [j for _, j in sorted(got[i])] == np.lexsort((np.arange(4000), d))[:5].tolist()
    assert stats["visited"] < stats["pairs"] / 5


def test_hot_point_is_split(spark, monkeypatch):
    """A third of the points at one place fill many blocks of bounded size."""
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    df = spark.createDataFrame([(i, [1.0, 1.0] if i % 3 == 0 else [float(i), 0.0]) for i in range(1500)], SCHEMA)
    space = neighbours.Space.build(Scratch(spark), df, "vec_id", "embedding")
    assert space.counts.sum() == 1500 and space.counts.max() < 120


def _without_structure(spark, n=600):
    r = np.random.default_rng(6)
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(r.normal(0, 1, (n, 6)))], SCHEMA)


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    """Where nearly all blocks meet, no exchange takes both blocks of every pair, and a task hands on k rows a probe."""
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    df = _without_structure(spark)
    stats: dict = {}
    near = neighbours.k_nearest(df, df, 4, stats=stats)
    assert stats["visited"] > stats["pairs"] / 2
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "right_v" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
    assert near.count() == 600 * 4


def test_held_keeps_the_nearest_of_all_that_passed():
    r = np.random.default_rng(8)
    q, x = np.round(r.normal(0, 1, (300, 2)), 1), np.round(r.normal(0, 1, (700, 2)), 1)  # many ties
    ids = r.permutation(700)
    for kind in ("L1", "L2"):
        held = neighbours.Held(np.arange(300), q, np.where(np.arange(300) % 2, np.inf, 0.3), 5, kind)
        for a in range(0, 700, 3 if kind == "L1" else 90):
            held.meet(ids[a : a + (3 if kind == "L1" else 90)], x[a : a + (3 if kind == "L1" else 90)])
        got = {}
        for p, n, d in zip(*(c.tolist() for c in held.found())):
            got.setdefault(p, []).append((n, d))
        for i, d in enumerate(neighbours._distances(q, x, kind)):
            want = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d))[:5] if i % 2 or d[j] <= 0.3]
            assert got.get(i, []) == want


def test_tree_shuffles_no_pairs_of_blocks(spark, monkeypatch):
    """Neither the neighbours nor the rounds of the spanning tree send both blocks of every pair through an exchange."""
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    monkeypatch.setattr(hdbscan, "NEAR", 3)  # so that rounds look among all points
    plans, plain = [], hdbscan.met

    def seen(*a):
        out = plain(*a)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(hdbscan, "met", seen)
    assert hdbscan.hdbscan(_without_structure(spark, 300), 5, 2).count() == 300
    assert plans and all("CartesianProduct" in p and "right_v" not in "".join(x for x in p.split("\n") if "Exchange" in x) for p in plans)


def test_density_predict_shuffles_no_pairs_of_blocks(spark, monkeypatch, tmp_path):
    """The query's own neighbours: no exchange takes both blocks of a pair."""
    from skarn.plans import learner_queries

    monkeypatch.setattr(neighbours, "BLOCK", 64)
    _without_structure(spark, 400).write.parquet(f"{tmp_path}/embeddings.parquet")
    plans, plain = [], neighbours.met

    def seen(*a):
        out = plain(*a)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(neighbours, "met", seen)
    assert learner_queries.density_predict(spark, str(tmp_path)).count() == 400
    assert any("CartesianProduct" in p for p in plans)
    assert not any("right_v" in x for p in plans if "CartesianProduct" in p for x in p.split("\n") if "Exchange" in x)
