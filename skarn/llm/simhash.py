"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 2-bit segments.  The
Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so all links lie within distance 3 of each other in the
embedding; of its two halves (16 segments each) one then lies within distance 1.  A unit grid
per half turns this range join into equality of cells: a point meets its own
cell and, if its half holds an odd number of bits (two points at distance 1 differ in
parity, so one side's neighbours do), the cells next to it.  Points that meet
are verified by exact Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import LOWER, UPPER, shared_dir, slices, written
from skarn.llm.components import connected_components

#: A cell of more fingerprints is compared in pairs of tiles of about this many.
TILE = 512
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (repeats count; fewer words: the whole sequence; none: 0)."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = len(words) - shingle + 1
    counts, hashes = np.zeros(64, np.int64), np.fromiter((xxhash.xxh64_intdigest(r, 42) for r in runs), np.uint64, n)
    for i in range(0, n, 65536):
        counts += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, key: Column | None = None) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit long, and the string ``key``; null text counts as empty."""
    extra = [] if key is None else ["key"]

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), *[b.column(c) for c in extra]], names=["doc_id", "fp", *extra])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")] + ([] if key is None else [key.alias("key")])
    return docs.select(columns).mapInArrow(run, "doc_id long, fp long" + ", key string" * len(extra))


def _cells(batches):
    """The cells in which each fingerprint takes part: (fp, cell, own)."""
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        bits = np.unpackbits(fp.astype(">i8").view(np.uint8)).reshape(-1, 32, 2).sum(axis=2, dtype=np.int64)
        for half in (0, 1):
            seg = bits[:, 16 * half : 16 * half + 16]
            power = np.int64(4) ** np.arange(16)
            own = seg @ power * 2 + half  # 2 bits a segment, 33 in all
            odd = np.flatnonzero(seg.sum(axis=1) % 2)
            near = np.concatenate([own[odd, None] + 2 * power, own[odd, None] - 2 * power], axis=1)
            inside = np.concatenate([seg[odd] < 2, seg[odd] > 0], axis=1)
            rows, cols = np.nonzero(inside)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([fp, fp[odd[rows]]])), pa.array(np.concatenate([own, near[rows, cols]])), pa.array(np.concatenate([np.ones(len(fp), bool), np.zeros(len(rows), bool)]))], names=["fp", "cell", "own"])


def _forest(fps: np.ndarray, own: np.ndarray, most: int):
    """Links enough to join all that ``most`` differing bits or fewer join, of which at least one side is at home in the cell."""
    fps = fps.view(np.uint64)  # a signed difference would be counted by its absolute value
    n, parent = len(fps), list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n - 1):
        rest = fps[i + 1 :]
        near = np.bitwise_count(rest ^ fps[i]) <= most
        if not own[i]:
            near &= own[i + 1 :]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield i, j


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that differ in ``most`` (3 at most) bits.

    Not all pairs: of each cell a spanning forest of its verified pairs, so every
    link between fingerprints keeps its two ends connected.
    """
    if most > 3:
        raise ValueError("the halves of the embedding bound distances up to 3")
    met = fps.select("fp").mapInArrow(_cells, "fp long, cell long, own boolean")
    met = written(met, "cells")
    # cells of one point have no pairs; large cells are cut into tiles, each pair of tiles a group of its own
    sizes = met.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.col("own").cast("int")).alias("home")).where("n > 1 and home = 1").select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    some = met.join(sizes, "cell")
    some = some.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    one = some.where("tiles = 1").select("cell", "fp", "own", F.lit(0).alias("s"), F.lit(0).alias("t"))
    more = some.where("tiles > 1").withColumn("x", other).select("cell", "fp", "own", F.least("tile", "x").alias("s"), F.greatest("tile", "x").alias("t"))
    groups = one.unionByName(more).groupBy("cell", "s", "t").agg(F.collect_list(F.struct("fp", "own")).alias("points"))

    def verified(batches):
        for batch in batches:
            column = batch.column("points")
            fp, own = column.flatten().field("fp").to_numpy(), column.flatten().field("own").to_numpy(zero_copy_only=False)
            at = column.offsets.to_numpy() - column.offsets[0].as_py()
            a, b = [], []
            for i, j in zip(at.tolist(), at[1:].tolist()):
                for x, y in _forest(fp[i:j], own[i:j], most):
                    a.append(fp[i + x])
                    b.append(fp[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.select("points").mapInArrow(verified, "a long, b long").distinct()


def _classes(fps: DataFrame, first: Column, most: int) -> DataFrame:
    """(fp, first, n_same, component) of each distinct fingerprint; a component is named by a fingerprint."""
    classes = fps.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n_same")).checkpoint()
    parts = connected_components(links(classes, most)).withColumnRenamed("node", "fp")
    return classes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links, itself included), n_same (rows of its fingerprint).

    Documents link if their fingerprints differ in ``most`` bits or fewer; equal fingerprints always link.
    Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows come out as often as they went in.  A null doc_id never is a
    component's id unless all ids of its component are null.
    """
    shared_dir(docs.sparkSession)
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    joined = _classes(fps, F.min("doc_id"), most)
    lowest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(lowest, "component").select("fp", "component_id", "n_same")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """Exactly one row of each component of ``near_duplicates``: that with the smallest id, of equal ids that with the smallest hash of the row.

    Components are told apart by their fingerprints, not by ids: texts that share an id but not a
    component are each kept, a null id comes after all others but keeps its row if its
    component has no other.  Rows that agree in all columns count as one.
    """
    shared_dir(docs.sparkSession)
    key = F.md5(F.to_json(F.struct(*docs.columns)).cast("binary"))
    fps = written(fingerprints(docs, id_col, text_col, shingle, key), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    first = _classes(fps, F.min(row), most).groupBy("component").agg(F.min("first").alias("first"))
    kept = docs.withColumn("_key", key).join(first.select(F.col("first.key").alias("_key")), "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).drop("_key")
