"""Small helpers that the operators share: scratch tables, guarded broadcasts, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast a side only up to this many bytes (measured); beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Python tasks work through their rows in slices of about this many UTF-8 bytes.
SLICE_BYTES = 1 << 20
#: Letters A-Z to a-z, the only case folding the contracts ask for.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or our own where it is unset and all run on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="skarn-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once to the shared folder: cuts lineage and survives lost executors.

    The table is removed by ``release``, or when the driver's session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skarn-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_removed, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def release(*tables: DataFrame) -> None:
    """Removes written tables that nothing lazy needs any more."""
    for df in tables:
        _, path = _PATHS.pop(id(df))
        _removed(df.sparkSession, path)


_PATHS: dict[int, tuple[DataFrame, str]] = {}


def _removed(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the session has gone already; the cluster's own clean-up takes the folder
        pass


def if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``limit`` bytes, else as it is (the join then shuffles).

    ``row_bytes`` is what a row takes in the hash table that a join builds of it, not in a file.
    ``df`` should be a written or checkpointed table: it is counted here.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n) + 64
        if batch.num_rows > start:
            yield batch.slice(start)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column's texts end to end, and where each text begins and the last one ends; null: empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, edges, data = column.buffers()
    at = np.frombuffer(edges, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word between ASCII white space begins and ends in such bytes, and each text's number of words."""
    space = (data == 32) | ((data - np.uint8(9)) < 5)
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    # words end with their text
    begins, ends = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
    first[begins], last[ends] = ~space[begins], ~space[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, at))


def runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of runs, end to end."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(int(ends[-1]) if len(ends) else 0)


#: Groups into which the partial results of tasks are dealt before the driver merges what is left of each.
FOLDS = 64


def folded(df: DataFrame, partial: Callable, merge: Callable, nothing: np.ndarray) -> np.ndarray:
    """One vector from all rows: ``partial`` turns the Arrow batches of a task into vectors of doubles, ``merge`` makes one of two.

    Tasks are merged FOLDS ways on executors, in the order of their partitions; FOLDS vectors at most reach the driver.  No rows: ``nothing``.
    """

    def one(batches):
        for v in partial(batches):
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v, np.float64).tobytes()], pa.binary())], names=["v"])

    def merged(table):
        at = np.argsort(table.column("part").to_numpy())
        out = None
        for raw in table.column("v").take(pa.array(at)).to_pylist():
            v = np.frombuffer(raw)
            out = v if out is None else merge(out, v)
        return pa.table({"v": pa.array([out.tobytes()], pa.binary()), "fold": table.column("fold").slice(0, 1)})

    parts = df.mapInArrow(one, "v binary").withColumn("part", F.spark_partition_id())
    parts = parts.withColumn("fold", F.pmod("part", F.lit(FOLDS))).groupBy("fold").applyInArrow(merged, "v binary, fold int")
    out = nothing
    for i, r in enumerate(sorted(parts.collect(), key=lambda r: r.fold)):
        out = np.frombuffer(r.v) if not i else merge(out, np.frombuffer(r.v))
    return out
