"""Nearest neighbours, exact, by a metric index: space is cut into balls, and balls that can't hold a neighbour are never compared.

Points go to the nearest of some pivots drawn from them, and each pivot's points to blocks of bounded size, with the radius
of each.  Probes are dealt the same way.  A block of probes first meets the blocks nearest to it that hold k points; the worst
k-th distance found there is a bound, and of the other blocks only those whose ball comes within it are met.  Each probe keeps its k nearest while
blocks pass, so what is written or shuffled grows with the points, not with the pairs of blocks.
The index is exact for every metric; without one (cosine) all blocks are met.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators import pairwise
from skarn.operators.scratch import Scratch

#: Points of a block, and pivots at most: a bound on what is broadcast (further points make more blocks a pivot).
BLOCK, MOST_PIVOTS = 1024, 16_384
#: Bytes of the blocks that a task holds while others pass, and of a row group of blocks.
PART, ROW_GROUP = 64 << 20, 16 << 20
#: More than the rounding of a distance.
SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    if kind == "L1":
        return np.array([np.abs(b - x).sum(axis=1) for x in a])
    if kind == "COSINE":
        d = a @ b.T
        n = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
        return 1 - np.divide(d, n, out=np.zeros_like(d), where=d != 0)
    return np.array([np.sqrt(((b - x) ** 2).sum(axis=1)) for x in a])


def vectors_of(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    at = column.offsets.to_numpy()
    return column.flatten().to_numpy().reshape(len(at) - 1, -1) if len(at) > 1 else np.empty((0, 1))


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared L2 distances by one matrix product, and more than its rounding."""
    own, other = (a**2).sum(axis=1), (b**2).sum(axis=1)
    near = np.column_stack([-2 * a, own, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), other]).T
    return near, 1e-12 * (own.max(initial=0) + other.max(initial=0))


def exactly(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L2 distances of rows to rows."""
    return np.sqrt(((b - a) ** 2).sum(axis=1))


class Held:
    """The k nearest points that each probe of a block has met so far, ties to the smaller id; ``most``: no farther one is wanted."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, most: np.ndarray, k: int, kind: str):
        self.ids, self.v, self.most, self.k, self.kind = ids, v, most.copy(), k, kind
        self.distance, self.of, self.n = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64), np.zeros(len(ids), int)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Bounds of all distances leave few pairs, which are computed exactly."""
        for a in range(0, len(self.ids), 256):
            q, most, first = self.v[a : a + 256], self.most[a : a + 256], min(self.k, len(ids)) - 1
            open_ = np.flatnonzero(np.isinf(most)) if len(ids) >= self.k else np.empty(0, int)
            if self.kind == "L2":
                near, slack = squares(q, x)
                limit = most**2
                if len(open_):
                    limit[open_] = np.partition(near[open_], first, axis=1)[:, first] + slack
                row, col = np.nonzero(near <= (limit + slack)[:, None])
                d = exactly(q[row], x[col])
            else:
                far = _distances(q, x, self.kind)
                limit = most.copy()
                if len(open_):
                    limit[open_] = np.partition(far[open_], first, axis=1)[:, first]
                row, col = np.nonzero(far <= limit[:, None])
                d = far[row, col]
            some = d <= most[row]
            if some.any():
                self._add(a + row[some], d[some], ids[col[some]])

    def _add(self, row: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        who = np.unique(row)
        before = np.arange(self.k)[None] < self.n[who][:, None]
        row, d, ids = np.concatenate([np.repeat(who, self.n[who]), row]), np.concatenate([self.distance[who][before], d]), np.concatenate([self.of[who][before], ids])
        order = np.lexsort((ids, d, row))
        row, d, ids = row[order], d[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        row, place = row[keep], place[keep]
        self.distance[row, place], self.of[row, place] = d[keep], ids[keep]
        self.n[who] = np.bincount(row, minlength=who[-1] + 1)[who]
        full = who[self.n[who] == self.k]
        self.most[full] = np.minimum(self.most[full], self.distance[full, self.k - 1])

    def found(self) -> list[np.ndarray]:
        """Probes, neighbours, distances."""
        held = np.arange(self.k)[None] < self.n[:, None]
        return [np.repeat(self.ids, self.n), self.of[held], self.distance[held]]


@dataclass
class Space:
    """Points dealt to balls: ``rows`` (id, v, block), and for each block its centre, radius and number of points."""

    rows: DataFrame
    pivots: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    distance: str

    @classmethod
    def build(cls, scratch: Scratch, df: DataFrame, id_col: str, vector: str, distance: str = "L2", pivots: np.ndarray | None = None) -> Space:
        """Null ids or vectors take no part.  pivots: those of another space; else a sample of the points, one for BLOCK of them."""
        rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        if pivots is None:
            n = min(MOST_PIVOTS, max(1, -(-rows.count() // BLOCK)))
            drawn = rows.orderBy(F.xxhash64("id"), "id").limit(n).collect()
            pivots = np.array([r.v for r in drawn], float) if drawn else np.empty((0, 1))

        def dealt(batches):
            for b in batches:
                x, cell, far = vectors_of(b.column("v")), [], []
                for a in range(0, len(x), 256):
                    d = _distances(x[a : a + 256], pivots, distance)
                    cell.append(d.argmin(axis=1))
                    far.append(d.min(axis=1))
                if len(x):
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(np.concatenate(cell)), pa.array(np.concatenate(far))], names=["id", "v", "cell", "far"])

        near = scratch.write(rows.mapInArrow(dealt, "id long, v array<double>, cell long, far double"), "dealt")
        cells = near.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()
        slices = [max(1, -(-r.n // BLOCK)) for r in cells]
        first = np.append(0, np.cumsum(np.array(slices, np.int64))).tolist()
        of = df.sparkSession.createDataFrame([(r.cell, first[i], slices[i]) for i, r in enumerate(cells)], "cell long, first long, slices long")
        block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("slices"))
        rows = near.join(F.broadcast(of), "cell").select("id", "v", "far", block.alias("block"))  # a row a pivot
        balls = {r.block: r for r in rows.groupBy("block").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
        centres = np.repeat(pivots[[r.cell for r in cells]], slices, axis=0) if cells else np.empty((0, 1))
        radii = np.array([balls[i].far if i in balls else 0.0 for i in range(first[-1])])
        return cls(rows.select("id", "v", "block"), pivots, centres, radii, np.array([balls[i].n if i in balls else 0 for i in range(first[-1])], int), distance)

    def packed(self, name: str, extra: DataFrame | None = None) -> DataFrame:
        """A row a block, ``name``_block and for each of id, v and the columns that ``extra`` has by id the values as bytes (see ``side``)."""
        rows = self.rows if extra is None else self.rows.join(extra, "id")
        fields = [c for c in rows.columns if c != "block"]

        def pack(t):
            made = {f"{name}_block": pa.array([t.column("block")[0].as_py()], pa.int64())}
            for c in fields:
                column = t.column(c).combine_chunks()
                values = vectors_of(column) if c == "v" else column.to_numpy(zero_copy_only=False)
                made[f"{name}_{c}"] = pa.array([np.ascontiguousarray(values).astype(KINDS[c]).tobytes()], pa.binary())
            return pa.table(made)

        return rows.groupBy("block").applyInArrow(pack, ", ".join([f"{name}_block long", *[f"{name}_{c} binary" for c in fields]]))

    def meets(self, other: Space, choose) -> Column:
        """The numbers of the blocks of ``other`` that ``choose`` names, of ``left_block``: a function of own block numbers, centre distances and least distances to all blocks of ``other``."""
        metric, kind = self.distance != "COSINE", self.distance
        mine, theirs = (self.centres, self.radii), (other.centres, other.radii, other.counts)

        @F.arrow_udf("array<int>")
        def run(numbers: pa.Array) -> pa.Array:
            blocks, at, out = numbers.to_numpy(), [np.zeros(1, np.int64)], [np.empty(0, np.int64)]
            for a in range(0, len(blocks), 64):
                some = blocks[a : a + 64]
                d = _distances(mine[0][some], theirs[0], kind)
                least = np.maximum(0, d - mine[1][some][:, None] - theirs[1][None]) * (1 - SLACK) if metric else np.zeros_like(d)
                keep = choose(some, d, least) & (theirs[2] > 0)[None]
                at.append(at[-1][-1] + np.cumsum(keep.sum(axis=1)))
                out.append(np.nonzero(keep)[1])
            return pa.ListArray.from_arrays(pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(out).astype(np.int32)))

        return run("left_block")

    def visited(self, meets: Column) -> int:
        """How many pairs of blocks ``meets`` names."""
        numbers = self.rows.sparkSession.createDataFrame([(i,) for i in np.flatnonzero(self.counts).tolist()], "left_block long")
        return numbers.select(F.sum(F.size(meets))).first()[0] or 0


#: Kinds of the values of packed blocks.
KINDS = {"id": np.int64, "v": np.float64, "most": np.float64, "core": np.float64, "own": np.int64, "open": np.bool_}


def side(b: pa.RecordBatch, name: str, r: int) -> dict[str, np.ndarray]:
    """The values of a packed block."""
    held = {c: np.frombuffer(b.column(f"{name}_{c}")[r].as_buffer(), kind) for c, kind in KINDS.items() if f"{name}_{c}" in b.schema.names}
    held["v"] = held["v"].reshape(len(held["id"]), -1)
    return held


def written(scratch: Scratch, packed: DataFrame, name: str) -> DataFrame:
    """Blocks in small row groups, of which a reader holds one at a time."""
    return scratch.write(packed, name, **{"parquet.block.size": str(ROW_GROUP), "parquet.page.size.row.check.min": "8", "parquet.block.size.row.check.min": "8", "parquet.enable.dictionary": "false"})


def met(left: DataFrame, right: DataFrame, meets: Column, q: Space, x: Space) -> DataFrame:
    """Both blocks of every pair in one row, the pairs dealt evenly to tasks.

    Pairs that are no more than the blocks themselves are shuffled.  More aren't: they would take the disk of all pairs.  Parts of the right blocks (``PART`` bytes)
    are then read by every task of the left ones, and pairs made as they are met: a left block meets all of a part before the next one comes.
    """
    tasks = pairwise.tasks(left.sparkSession)
    left = left.withColumn("meets", meets)
    blocks = int((q.counts > 0).sum()), int((x.counts > 0).sum())
    if q.visited(meets) <= sum(blocks):
        return left.withColumn("right_block", F.explode("meets")).drop("meets").withColumn("right_block", F.col("right_block").cast("long")).join(right, "right_block").repartition(tasks)
    parts = max(1, -(-int(x.counts.sum()) * 8 * (x.centres.shape[1] + 3) // PART))
    own = left.repartition(max(1, min(blocks[0], -(-tasks // parts))))
    return own.join(right.coalesce(parts).hint("shuffle_replicate_nl"), F.array_contains("meets", F.col("right_block").cast("int"))).drop("meets")


def k_nearest(probes: DataFrame, points: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", distance: str = "L2", stats: dict | None = None) -> DataFrame:
    """(probe, rank from 1, neighbour, distance): the k points nearest to each probe, ties to the smaller id; a point is its own neighbour.

    Fewer than k points give fewer rows.  Null ids or vectors take no part; all vectors have one length.
    stats: a dictionary that gets the number of block pairs there are (``pairs``) and how many were compared (``visited``).
    """
    scratch = Scratch(points.sparkSession)
    x = Space.build(scratch, points, id_col, vector, distance)
    empty = points.sparkSession.createDataFrame([], "probe long, rank int, neighbour long, distance double")
    if not len(x.counts):
        return empty
    q = x if probes is points else Space.build(scratch, probes, id_col, vector, distance, x.pivots)
    if not len(q.counts):
        return empty
    return search(scratch, q, x, k, stats)


def search(scratch: Scratch, q: Space, x: Space, k: int, stats: dict | None = None) -> DataFrame:
    """``k_nearest`` between two spaces."""
    kind, counts = q.distance, x.counts

    def best(batches):
        block, held = None, None

        def out():
            found = held.found()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), block, np.int64)), *[pa.array(c) for c in found]], names=["block", "probe", "neighbour", "distance"])

        for b in batches:
            for r in range(b.num_rows):
                if held is None or b.column("left_block")[r].as_py() != block:
                    if held is not None:
                        yield out()
                    own = side(b, "left", r)
                    block, held = b.column("left_block")[r].as_py(), Held(own["id"], own["v"].copy(), own.get("most", np.full(len(own["id"]), np.inf)), k, kind)
                other = side(b, "right", r)
                held.meet(other["id"], other["v"])
        if held is not None:
            yield out()

    left, right = written(scratch, q.packed("left"), "left"), written(scratch, x.packed("right"), "right")
    compared = lambda left, meets: met(left, right, meets, q, x).mapInArrow(best, "block long, probe long, neighbour long, distance double")

    def nearest(blocks, d, least):
        """The blocks of the nearest centres that hold k points."""
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(counts[order], axis=1)
        keep = np.zeros(d.shape, bool)
        np.put_along_axis(keep, order, np.column_stack([np.full(len(d), True), held[:, :-1] < k]), axis=1)
        return keep

    rank = F.row_number().over(Window.partitionBy("probe").orderBy("distance", "neighbour"))
    first = q.meets(x, nearest)
    found = scratch.write(compared(left, first).withColumn("rank", rank).where(F.col("rank") <= k), "found")
    reach = scratch.write(found.groupBy("block", "probe").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("most")), "reach")
    bound = np.full(len(q.counts), -1.0)
    for r in reach.groupBy("block").agg(F.max("most").alias("most")).collect():  # a number a block
        bound[r.block] = r.most
    others = q.meets(x, lambda blocks, d, least: (least <= bound[blocks][:, None]) & ~nearest(blocks, d, least))
    if stats is not None:
        stats |= {"pairs": int((q.counts > 0).sum() * (x.counts > 0).sum()), "visited": q.visited(first) + q.visited(others)}
    bounded = written(scratch, q.packed("left", reach.select(F.col("probe").alias("id"), "most")), "left")
    every = found.select("probe", "neighbour", "distance").unionByName(compared(bounded, others).select("probe", "neighbour", "distance"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("probe", "rank", "neighbour", "distance")


def core_distances(points: DataFrame, k: int, **options) -> DataFrame:
    """(id, core_distance): the distance of the k-th nearest, itself counted."""
    near = k_nearest(points, points, k, **options)
    return near.groupBy(F.col("probe").alias("id")).agg(F.max("distance").alias("core_distance"))


def knn_vote(near: DataFrame, labels: DataFrame, id_col: str, label: str, weighted: bool = False) -> DataFrame:
    """(probe, prediction, votes): the label of most neighbours (or of the greatest sum of 1 / distance), ties to the label that sorts first."""
    votes = near.join(labels.select(F.col(id_col).alias("neighbour"), F.col(label).alias("label")), "neighbour").groupBy("probe", "label").agg((F.sum(1 / F.greatest("distance", F.lit(1e-12))) if weighted else F.count("*")).alias("votes"))
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("votes"), "label"))
    return votes.withColumn("rank", rank).where("rank = 1").select("probe", F.col("label").alias("prediction"), "votes")


def knn_mean(near: DataFrame, targets: DataFrame, id_col: str, target: str) -> DataFrame:
    """(probe, prediction): the mean of the neighbours' targets."""
    return near.join(targets.select(F.col(id_col).alias("neighbour"), F.col(target).alias("y")), "neighbour").groupBy("probe").agg(F.avg("y").alias("prediction"))
