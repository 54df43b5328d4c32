"""HDBSCAN*: density clusters from the minimum spanning tree of mutual reachability distances.

Everything that has a row a point is a table:

* core distances and candidate edges come from the metric index of ``neighbours``;
* the spanning tree is Boruvka's: in each round a component's lightest edge is looked up among the candidates, and where these
  can't prove it (a point's k-th neighbour is nearer than the edge) among the blocks within reach; components are joined by pointer jumping;
* a point is noise below the level at which its component has ``least`` points, found from the tree by ``least`` - 1 joins;
* points slide along the tree to the density minimum below them.  A minimum is a candidate cluster: it stands for ``least`` points or more.

The hierarchy of the minima is what the driver holds, MOST_MINIMA of them at most, and beside it counts and sums a cluster; labels and
scores go back to the points by a walk up that hierarchy.  Edges of one weight go at once, so a cluster can fall into more than two.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.neighbours import SLACK, Space, _distances, exactly, met, search, side, squares, vectors_of, written
from skarn.operators.scratch import Scratch

NOISE = 0
#: Candidate edges that the index gives for each point, at least.
NEAR = 10
#: Density minima whose hierarchy the driver holds; each stands for ``least`` points at least.
MOST_MINIMA = 4_000_000
#: The noise score where no point is noise.
NOISE_SCORE = 0.9999


def roots(scratch: Scratch, pointers: DataFrame) -> DataFrame:
    """(id, root) of a table (id, up) without circles but pairs that point at each other, of which the smaller is a root; who isn't in the table is one."""
    p = pointers.alias("p").join(pointers.alias("q"), F.col("p.up") == F.col("q.id"), "left")
    p = scratch.write(p.select("p.id", F.when((F.col("q.up") == F.col("p.id")) & (F.col("p.id") < F.col("p.up")), F.col("p.id")).otherwise(F.col("p.up")).alias("up")), "up")
    while True:
        q = p.select(F.col("id").alias("up"), F.col("up").alias("next"))
        p = scratch.write(p.join(q, "up", "left").select("id", F.coalesce("next", "up").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "up")
        if p.where("moved").isEmpty():
            return p.select("id", F.col("up").alias("root"))
        p = p.select("id", "up")


def spanning_tree(scratch: Scratch, space: Space, k: int) -> tuple[DataFrame, DataFrame]:
    """((a, b, w) with a < b: a minimum spanning tree of max(core a, core b, distance); (id, core))."""
    spark = space.rows.sparkSession
    n_near = max(k, NEAR) + 1
    near = scratch.write(search(scratch, space, space, n_near), "near")
    by_rank = lambda r: F.coalesce(F.max(F.when(F.col("rank") == r, F.col("distance"))), F.lit(float("inf")))
    seen = near.groupBy(F.col("probe").alias("id")).agg(F.max(F.when(F.col("rank") <= k, F.col("distance"))).alias("core"), by_rank(n_near).alias("far"))
    seen = scratch.write(seen.withColumn("core", F.when(F.lit(k > 1), F.col("core")).otherwise(0.0)), "core")
    core = lambda c: seen.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"))
    edges = near.where("probe <> neighbour").select(F.least("probe", "neighbour").alias("a"), F.greatest("probe", "neighbour").alias("b"), "distance").distinct()
    edges = scratch.write(edges.join(core("a"), "a").join(core("b"), "b").select("a", "b", F.greatest("distance", "core_a", "core_b").alias("w")), "edges")
    state = scratch.write(seen.select("id", F.col("id").alias("own")), "state")
    n_own, tree = int(space.counts.sum()), spark.createDataFrame([], "a long, b long, w double")
    while n_own > 1:
        of = lambda c: state.select(F.col("id").alias(c), F.col("own").alias(f"own_{c}"))
        edges = scratch.write(edges.select("a", "b", "w").join(of("a"), "a").join(of("b"), "b").where("own_a <> own_b"), "edges")
        ways = edges.select(F.explode(F.array(F.struct(F.col("own_a").alias("own"), "w", "a", "b", F.col("own_b").alias("up")), F.struct(F.col("own_b").alias("own"), "w", "a", "b", F.col("own_a").alias("up")))).alias("e"))
        lightest = ways.select("e.*").groupBy("own").agg(F.min(F.struct("w", "a", "b", "up")).alias("e"))
        bounds = state.join(seen, "id").groupBy("own").agg(F.min("far").alias("far"))
        best = scratch.write(bounds.join(lightest, "own", "left").select("own", "far", "e.w", "e.a", "e.b", "e.up"), "best")
        # an edge that isn't a candidate weighs as much as the k-th distance of its ends: below it the lightest is proved
        chosen, n_proved = best.where("w < far"), best.where("w < far").count()
        if n_proved * 4 < n_own:
            found = _lightest(scratch, space, state.join(seen, "id").join(best.select("own", F.coalesce("w", F.lit(float("inf"))).alias("most"), (F.coalesce("w", F.lit(float("inf"))) < F.col("far")).alias("proved")), "own"))
            found = found.unionByName(best.where("w IS NOT NULL").select("own", "w", "a", "b", "up")).groupBy("own").agg(F.min(F.struct("w", "a", "b", "up")).alias("e"))
            chosen = scratch.write(found.select("own", "e.*"), "chosen")
        tree = tree.unionByName(scratch.write(chosen.select("a", "b", "w").distinct(), "tree"))
        up = roots(scratch, chosen.select(F.col("own").alias("id"), "up"))
        state = scratch.write(state.join(up.select(F.col("id").alias("own"), "root"), "own", "left").select("id", F.coalesce("root", "own").alias("own")), "state")
        n_own = state.select("own").distinct().count()
    return scratch.write(tree, "tree"), seen.select("id", "core")


def _least(p: dict[str, np.ndarray], q: dict[str, np.ndarray], most: np.ndarray, kind: str):
    """(row, row of the other side, weight) of each row's lightest pairs with another component up to ``most``, exact and with all ties.

    A matrix product tells which pairs can be the lightest; only these are computed as everywhere else.
    """
    other = p["own"][:, None] != q["own"][None]
    if kind == "L2":
        near, slack = squares(p["v"], q["v"])
        bound, wide = most**2, 2 * slack
    else:
        near, wide, bound = _distances(p["v"], q["v"], kind), 0.0, most.copy()
    if len(some := np.flatnonzero(np.isinf(most))):
        heavy = np.maximum(p["core"][some][:, None], q["core"][None])
        bound[some] = np.where(other[some], np.maximum(near[some] + wide, heavy**2 if kind == "L2" else heavy), np.inf).min(axis=1)
    x, y = np.nonzero((near <= (bound + wide)[:, None]) & other)
    w = np.maximum(exactly(p["v"][x], q["v"][y]) if kind == "L2" else near[x, y], np.maximum(p["core"][x], q["core"][y]))
    least = most.copy()
    np.minimum.at(least, x, w)
    keep = w <= least[x]
    yield from zip(x[keep].tolist(), y[keep].tolist(), w[keep].tolist())


def _lightest(scratch: Scratch, space: Space, rows: DataFrame) -> DataFrame:
    """(own, w, a, b, up): for the components that have no proof their lightest edges among all points; ``most`` bounds them from above.

    Only points whose k-th neighbour isn't beyond that bound can have one, and only blocks within it, of another component, are met.
    """
    rows = scratch.write(rows.select("id", "own", "core", "most", (~F.col("proved") & (F.col("far") <= F.col("most"))).alias("open")), "open")
    n = len(space.counts)
    bound, low, high = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in space.rows.select("id", "block").join(rows, "id").groupBy("block").agg(F.max(F.when(F.col("open"), F.col("most"))).alias("most"), F.min("own").alias("low"), F.max("own").alias("high")).collect():
        bound[r.block], low[r.block], high[r.block] = -1.0 if r.most is None else r.most, r.low, r.high  # a row a block
    one = low == high
    within = lambda blocks, d, least: (least <= bound[blocks][:, None]) & ~(one[blocks][:, None] & one[None] & (low[blocks][:, None] == low[None]))
    left, right = written(scratch, space.packed("left", rows), "left"), written(scratch, space.packed("right", rows.select("id", "own", "core")), "right")
    kind, centres, radii = space.distance, space.centres, space.radii

    def run(batches):
        best: dict[int, tuple] = {}
        for b in batches:
            for r in range(b.num_rows):
                p, q, ball = side(b, "left", r), side(b, "right", r), b.column("right_block")[r].as_py()
                reach = p["most"] if kind == "COSINE" else p["most"] - (_distances(centres[ball][None], p["v"], kind)[0] - radii[ball]) * (1 - SLACK)
                open_ = np.flatnonzero(p["open"] & (reach >= 0))  # whose component's bound comes to the ball
                for s in range(0, len(open_), 256):
                    some = {c: v[open_[s : s + 256]] for c, v in p.items()}
                    owns = some["own"].tolist()
                    most = np.minimum(some["most"], [best[o][0] if o in best else np.inf for o in owns])
                    for x, y, w in _least(some, q, most, kind):
                        i, j = int(some["id"][x]), int(q["id"][y])
                        e = (w, min(i, j), max(i, j), int(q["own"][y]))
                        if owns[x] not in best or e < best[owns[x]]:
                            best[owns[x]] = e
        if best:
            yield pa.RecordBatch.from_pylist([{"own": o, "w": e[0], "a": e[1], "b": e[2], "up": e[3]} for o, e in best.items()])

    return met(left, right, space.meets(space, within), space, space).mapInArrow(run, "own long, w double, a long, b long, up long")


def noise_levels(scratch: Scratch, tree: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """(id, eps): the least weight at which a point's component has ``least`` points; null where no component does.

    Each point adds the lightest edge that leaves what it has reached, ``least`` - 1 times; of a point's edges only so many can be taken.
    """
    both = tree.select(F.explode(F.array(F.struct(F.col("a").alias("u"), "w", F.col("b").alias("v")), F.struct(F.col("b").alias("u"), "w", F.col("a").alias("v")))).alias("e")).select("e.*")
    rank = F.row_number().over(Window.partitionBy("u").orderBy("w", "v"))
    links = both.withColumn("r", rank).where(F.col("r") < least).groupBy("u").agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("links"))
    links = scratch.write(links, "links")
    state = ids.join(links, F.col("id") == F.col("u"), "left").select("id", F.array("id").alias("seen"), F.lit(0.0).alias("eps"), F.coalesce("links", F.array().cast("array<struct<w:double,v:long>>")).alias("out"))
    for nth in range(1, least):
        step = state.select("id", "seen", "eps", "out", F.try_element_at("out", F.lit(1)).alias("e")).join(links, F.col("e.v") == F.col("u"), "left")
        fresh = F.filter(F.coalesce("links", F.array()), lambda x: ~F.array_contains("seen", x.v))
        left = F.array_sort(F.concat(F.slice("out", 2, least), fresh))
        state = step.select("id", F.when(F.col("e").isNull(), F.col("seen")).otherwise(F.concat("seen", F.array("e.v"))).alias("seen"), F.when(F.col("e").isNotNull(), F.greatest("eps", "e.w")).alias("eps"), F.slice(left, 1, least - nth).alias("out"))
        if nth % 4 == 0:
            state = scratch.write(state, "reached")
    return scratch.write(state.select("id", "eps"), "eps")


@dataclass
class Hierarchy:
    """Clusters, children before parents: from the level ``died`` (they fall apart) to ``born`` (above it they are part of ``parent``); ``leaf`` is that of each minimum."""

    minima: np.ndarray
    leaf: np.ndarray
    parent: np.ndarray
    born: np.ndarray
    died: np.ndarray

    @classmethod
    def build(cls, minima: dict[int, float], edges: list[tuple[float, int, int]]) -> Hierarchy:
        """From the minima's levels and the edges between them.  A minimum that another reaches at its own level is no cluster of its own."""
        ids = sorted(minima)
        number = {x: i for i, x in enumerate(ids)}
        up = list(range(len(ids)))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        node: list[int | None] = [None] * len(ids)  # of each component, once it has one
        alias: dict[int, list[int]] = {i: [i] for i in range(len(ids))}  # minima that wait for their component's first cluster
        leaf, parent, born, died = [-1] * len(ids), [], [], []
        edges, at = sorted(edges), 0

        def made(level: float) -> int:
            parent.append(-1)
            born.append(np.inf)
            died.append(level)
            return len(parent) - 1

        level_of = [minima[x] for x in ids]
        while at < len(edges):
            w, stop = edges[at][0], at
            while stop < len(edges) and edges[stop][0] == w:
                stop += 1
            parts: dict[int, set[int]] = {}  # component after -> components before
            old = {root(number[x]) for e in edges[at:stop] for x in e[1:]}
            for _, a, b in edges[at:stop]:
                p, q = root(number[a]), root(number[b])
                if p != q:
                    up[q] = p
            for o in old:
                parts.setdefault(root(o), set()).add(o)
            for new, before in parts.items():
                real = [o for o in before if node[o] is not None or level_of[o] < w]
                for o in real:
                    if node[o] is None:
                        node[o] = made(level_of[o])
                        for i in alias.pop(o):
                            leaf[i] = node[o]
                if len(real) > 1:
                    own = made(w)
                    for o in real:
                        parent[node[o]], born[node[o]] = own, w
                else:
                    own = node[real[0]] if real else None
                waiting = [i for o in before if o in alias for i in alias.pop(o)]
                node[new] = own
                if own is None:
                    alias[new] = waiting
                else:
                    for i in waiting:
                        leaf[i] = own
            at = stop
        for o, waiting in alias.items():
            if node[o] is None:
                node[o] = made(level_of[o])
            for i in waiting:
                leaf[i] = node[o]
        return cls(np.array(ids, np.int64), np.array(leaf, np.int64), np.array(parent, np.int64), np.array(born), np.array(died))

    def ancestors(self) -> list[np.ndarray]:
        """The 1st, 2nd, 4th, ... ancestor of every cluster; a root's is itself."""
        out = [np.where(self.parent < 0, np.arange(len(self.parent)), self.parent)]
        while (out[-1] != out[-1][out[-1]]).any():
            out.append(out[-1][out[-1]])
        return out

    def climb(self, minima: np.ndarray, levels: np.ndarray, ancestors: list[np.ndarray]) -> np.ndarray:
        """The cluster that holds the minimum at the level: the first ancestor that is born above it."""
        at = self.leaf[np.searchsorted(self.minima, minima)]
        for jump in ancestors[::-1]:
            low = self.born[at] <= levels
            to = jump[at]
            # jump as long as even the one before the target is born too low
            at = np.where(low & (self.born[to] <= levels), to, at)
        return np.where(self.born[at] <= levels, ancestors[0][at], at)

    def select(self, count: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chosen cluster that each lies in or -1, lowest level below each).  count, inverse: points that leave a cluster as noise, and their summed 1 / level."""
        n = len(self.parent)
        size, stability, value, deepest, kids = count.astype(float), np.zeros(n), np.zeros(n), self.died.copy(), np.zeros(n, bool)
        over = lambda x: 1 / max(x, 1e-300)
        passed, below, lowest = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        for c in range(n):
            size[c] += passed[c]
            base = over(self.born[c]) if np.isfinite(self.born[c]) else 0.0
            stability[c] = inverse[c] - count[c] * base + passed[c] * (over(self.died[c]) - base)
            deepest[c] = lowest[c] if kids[c] else self.died[c]
            value[c] = max(stability[c], below[c]) if kids[c] else stability[c]
            p = self.parent[c]
            if p >= 0:
                passed[p] += size[c]
                below[p] += value[c]
                lowest[p], kids[p] = min(lowest[p], deepest[c]), True
        of = np.full(n, -1)
        for c in range(n - 1, -1, -1):
            p = self.parent[c]
            if p >= 0:
                of[c] = of[p] if of[p] >= 0 else c if not kids[c] or stability[c] >= below[c] else -1
        return of, deepest


@dataclass
class Exemplars:
    """The points of each cluster with the lowest outlier scores, and how far the others of it lie from them."""

    clusters: np.ndarray
    vectors: np.ndarray
    scores: np.ndarray
    reach: np.ndarray


@dataclass
class Model:
    """``assigned`` (id, cluster from 1 or 0 for noise, outlier_score), the exemplars that predict, and the score of noise."""

    assigned: DataFrame
    exemplars: Exemplars
    noise_score: float
    distance: str

    def predict(self, probes: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(probe, cluster, outlier_score): the cluster and score of the nearest exemplar; noise for a probe that no exemplar reaches.

        An exemplar reaches as far as its cluster does.  Null ids or vectors take no part.
        """
        x, noise, kind = self.exemplars, self.noise_score, self.distance
        rows = probes.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("probe"), F.col(vector).cast("array<double>").alias("v"))

        def run(batches):
            for b in batches:
                v, n = vectors_of(b.column("v")), b.num_rows
                cluster, score = np.full(n, NOISE, np.int32), np.full(n, noise)
                for a in range(0, n if len(x.clusters) else 0, 256):
                    d = _distances(v[a : a + 256], x.vectors, kind)
                    near, inside = d.argmin(axis=1), (d <= x.reach[None]).any(axis=1)
                    cluster[a : a + 256] = np.where(inside, x.clusters[near], NOISE)
                    score[a : a + 256] = np.where(inside, x.scores[near], noise)
                yield pa.RecordBatch.from_arrays([b.column("probe"), pa.array(cluster), pa.array(score)], names=["probe", "cluster", "outlier_score"])

        return rows.mapInArrow(run, "probe long, cluster int, outlier_score double")


def _hierarchy(scratch: Scratch, tree: DataFrame, eps: DataFrame) -> tuple[Hierarchy, DataFrame]:
    """(hierarchy of the density minima, (id, eps, minimum) of the points)."""
    level = lambda c: eps.select(F.col("id").alias(c), F.col("eps").alias(f"eps_{c}"))
    edges = tree.join(level("a"), "a").join(level("b"), "b").select("a", "b", "eps_a", "eps_b", F.greatest("w", "eps_a", "eps_b").alias("w"))
    edges = scratch.write(edges, "levels")
    ways = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("eps_a").alias("eps"), F.col("eps_b").alias("low"), F.col("b").alias("up"), "w"), F.struct(F.col("b").alias("id"), F.col("eps_b").alias("eps"), F.col("eps_a").alias("low"), F.col("a").alias("up"), "w"))).alias("e")).select("e.*")
    # whoever joins a lower point at the level at which it is no more noise slides there
    down = ways.where((F.col("w") == F.col("eps")) & ((F.col("low") < F.col("eps")) | ((F.col("low") == F.col("eps")) & (F.col("up") < F.col("id"))))).groupBy("id").agg(F.min(F.struct("low", "up")).alias("to"))
    found = roots(scratch, down.select("id", F.col("to.up").alias("up")))
    points = scratch.write(eps.join(found, "id", "left").select("id", "eps", F.coalesce("root", "id").alias("minimum")), "minima")
    at = lambda c: points.select(F.col("id").alias(c), F.col("minimum").alias(f"m_{c}"))
    between = scratch.write(edges.join(at("a"), "a").join(at("b"), "b").where("m_a <> m_b").select("w", "m_a", "m_b"), "between")
    if (n := between.count()) >= MOST_MINIMA:
        raise ValueError(f"{n} density minima are beyond the bound of {MOST_MINIMA}: a larger ``least`` makes fewer")
    minima = {r.id: r.eps for r in points.where("id = minimum").collect()}
    return Hierarchy.build(minima, [(r.w, r.m_a, r.m_b) for r in between.collect()]), points


def _exemplars(assigned: DataFrame, rows: DataFrame, distance: str, seed: int) -> Exemplars:
    """Of each cluster, in proportion to its size, the points of the lowest distinct scores (of equal ones that with the largest id); where these are too few also others, by a seeded hash."""
    sizes = {r.cluster: r.n for r in assigned.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    clusters = sorted(c for c in sizes if c != NOISE)
    if not clusters:
        return Exemplars(np.empty(0, np.int32), np.empty((0, 1)), np.empty(0), np.empty(0))
    total = int((n / 2) ** 0.5) + len(sizes)
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(c, max(1, sizes[c] * total // n)) for c in clusters], "cluster int, wanted int")
    inside = assigned.where(F.col("cluster") != NOISE)
    distinct = inside.groupBy("cluster", "outlier_score").agg(F.max("id").alias("id"))
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("outlier_score")))
    scores = {r.cluster: r.n for r in distinct.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    few = {r.cluster: r.wanted - scores[r.cluster] for r in wanted.collect() if r.wanted >= scores[r.cluster]}
    chosen = ranked.join(F.broadcast(wanted), "cluster").where("rank <= wanted").select("cluster", "id", "outlier_score", "rank")
    if any(few.values()):
        more = spark.createDataFrame([(c, k, scores[c]) for c, k in few.items()], "cluster int, more int, after int")
        drawn = inside.withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))).join(F.broadcast(more), "cluster").where("nth <= more")
        chosen = chosen.unionByName(drawn.select("cluster", "id", "outlier_score", (F.col("nth") + F.col("after")).alias("rank")))
    held = chosen.join(rows.select("id", "v"), "id").orderBy("cluster", "rank").collect()  # about the square root of half the points
    of, v, score = np.array([r.cluster for r in held], np.int32), np.array([r.v for r in held], float), np.array([r.outlier_score for r in held])
    # measured against the distinct scores that were not chosen, or against all of a cluster that has too few
    last = spark.createDataFrame([(c, c in few) for c in clusters], "cluster int, every boolean")
    others = inside.join(ranked.select("id", "rank"), "id", "left").join(F.broadcast(wanted), "cluster").join(F.broadcast(last), "cluster").where("every OR rank > wanted").select("id", "cluster").join(rows.select("id", "v"), "id")

    def farthest(batches):
        reach = np.full(len(of), -np.inf)
        for b in batches:
            cluster, x = b.column("cluster").to_numpy(), vectors_of(b.column("v"))
            for c in np.unique(cluster).tolist():
                own, some = np.flatnonzero(of == c), x[cluster == c]
                for a in range(0, len(own), 256):
                    reach[own[a : a + 256]] = np.maximum(reach[own[a : a + 256]], _distances(v[own[a : a + 256]], some, distance).max(axis=1))
        at = np.flatnonzero(np.isfinite(reach))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(reach[at])], names=["nth", "reach"])

    reach = np.full(len(of), -np.inf)
    for r in others.mapInArrow(farthest, "nth long, reach double").groupBy("nth").agg(F.max("reach").alias("reach")).collect():
        reach[r.nth] = r.reach
    return Exemplars(of, v, score, reach)


def fit(points: DataFrame, least: int = 5, k: int | None = None, id_col: str = "vec_id", vector: str = "embedding", distance: str = "L2", seed: int = 1) -> Model:
    """A model of the points.  least (2 or more): points of the smallest cluster; k: the neighbour (itself counted) that sets a point's core distance.

    Clusters are numbered from 1 by their smallest id.  A point's outlier score is 1 - (lowest level of its last cluster) / (its own level).
    Null ids or vectors take no part; ids must be unique and vectors of one length.  Fewer points than ``least`` are noise of score 0.
    The scratch tables of the fit go when the session ends: ``assigned`` reads them.
    """
    if least < 2:
        raise ValueError("a cluster has two points at least")
    spark, scratch = points.sparkSession, Scratch(points.sparkSession)
    space = Space.build(scratch, points, id_col, vector, distance)
    nothing = Exemplars(np.empty(0, np.int32), np.empty((0, 1)), np.empty(0), np.empty(0))
    if not len(space.counts):
        return Model(spark.createDataFrame([], "id long, cluster int, outlier_score double"), nothing, NOISE_SCORE, distance)
    if space.counts.sum() < least:
        return Model(space.rows.select("id", F.lit(NOISE).alias("cluster"), F.lit(0.0).alias("outlier_score")), nothing, NOISE_SCORE, distance)
    tree, core = spanning_tree(scratch, space, k or least)
    hierarchy, placed = _hierarchy(scratch, tree, noise_levels(scratch, tree, core.select("id"), least))
    ancestors = hierarchy.ancestors()

    def climbed(batches):
        for b in batches:
            at = hierarchy.climb(b.column("minimum").to_numpy(), b.column("eps").to_numpy(), ancestors)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("eps"), pa.array(at)], names=["id", "eps", "node"])

    placed = scratch.write(placed.mapInArrow(climbed, "id long, eps double, node long"), "placed")
    n = len(hierarchy.parent)
    count, inverse, first = np.zeros(n), np.zeros(n), np.full(n, np.inf)
    for r in placed.groupBy("node").agg(F.count("*").alias("n"), F.sum(1 / F.greatest("eps", F.lit(1e-300))).alias("i"), F.min("id").alias("id")).collect():  # a row a cluster
        count[r.node], inverse[r.node], first[r.node] = r.n, r.i, r.id
    of, deepest = hierarchy.select(count, inverse)
    smallest: dict[int, float] = {}
    for c in range(n):
        if of[c] >= 0:
            smallest[of[c]] = min(smallest.get(of[c], np.inf), first[c])
    names = {c: i + 1 for i, c in enumerate(sorted(smallest, key=smallest.get))}
    label = np.array([names[c] if c >= 0 else NOISE for c in of.tolist()], np.int32)

    def told(batches):
        for b in batches:
            node, eps = b.column("node").to_numpy(), b.column("eps").to_numpy()
            score = np.where(eps > 0, 1 - np.divide(deepest[node], eps, out=np.ones(len(eps)), where=eps > 0), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(label[node]), pa.array(score)], names=["id", "cluster", "outlier_score"])

    assigned = scratch.write(placed.mapInArrow(told, "id long, cluster int, outlier_score double"), "assigned")
    noise = assigned.where(F.col("cluster") == NOISE).agg(F.max("outlier_score")).first()[0]
    return Model(assigned, _exemplars(assigned, space.rows, distance, seed), NOISE_SCORE if noise is None else noise, distance)


def hdbscan(points: DataFrame, least: int = 5, k: int | None = None, id_col: str = "vec_id", vector: str = "embedding", distance: str = "L2") -> DataFrame:
    """(id, cluster from 1 or 0 for noise, outlier_score): the assignments of ``fit``."""
    return fit(points, least, k, id_col, vector, distance).assigned


def predict(probes: DataFrame, model: Model, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``model.predict``."""
    return model.predict(probes, id_col, vector)
