"""Linear models that learn from a stream, batch by batch, each batch once.

Every batch makes a version of the model: its parameters, the optimiser's sums and steps, as Parquet in ``version=<batch id>``, complete once
its ``_SUCCESS`` is there.  A batch whose version is complete isn't learnt from again, and one that failed starts from the version before it, so a stream
that is killed anywhere and restarted from its checkpoint gives the model of a stream that wasn't.  The driver holds the parameters, whose number is checked.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skarn.operators.linear import MOST_PARAMETERS, OBJECTIVES, Linear, Optimiser, descend, encoded, matrix


@dataclass
class Version:
    """``rows`` learnt from in all, ``steps`` taken, ``loss``: the mean loss of the version's batch before it was learnt from."""

    number: int
    stream: str
    rows: int
    steps: int
    loss: float
    weights: np.ndarray
    a: np.ndarray
    b: np.ndarray


class ModelStore:
    """The versions of one model in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """The numbers of the complete versions, ascending."""
        fs, at = self._at(self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        numbers = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
        return sorted(n for n in numbers if fs.exists(self._at(f"{self.path}/version={n}/_SUCCESS")[1]))

    def read(self, number: int) -> Version:
        t = self.spark.read.parquet(f"{self.path}/version={number}").orderBy("i").toArrow()
        one = lambda c: t.column(c)[0].as_py()
        return Version(number, one("stream"), one("rows"), one("steps"), one("loss"), *[t.column(c).to_numpy() for c in ("weight", "a", "b")])

    def write(self, v: Version) -> None:
        n = len(v.weights)
        same = {"stream": v.stream, "rows": v.rows, "steps": v.steps, "loss": v.loss}
        t = pa.table({"i": np.arange(n), "weight": v.weights, "a": v.a, "b": v.b, **{k: pa.array([x] * n) for k, x in same.items()}})
        self.spark.createDataFrame(t).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/version={v.number}")

    def keep_last(self, n: int) -> None:
        for old in self.versions()[:-n]:
            fs, at = self._at(f"{self.path}/version={old}")
            fs.delete(at, True)

    def history(self) -> DataFrame:
        """(version, rows, steps, loss) of the complete versions kept."""
        rows = [(v.number, v.rows, v.steps, v.loss) for v in map(self.read, self.versions())]
        return self.spark.createDataFrame(rows, "version long, rows long, steps long, loss double")


class StreamedLinear:
    """Learns a linear model from the batches of a stream.

    features, target, weight: columns, as in ``linear.fit``; width: the number of features, the same in all batches; epochs: steps a batch takes.
    Rows without features or target aren't learnt from; a batch without any makes no version.  keep: complete versions that stay in the store.
    """

    def __init__(self, store: ModelStore, features: str, target: str, outputs: list[str], width: int, objective: str = "log", optimiser: Optimiser | None = None, epochs: int = 1, weight: str | None = None, keep: int = 10):
        if (width + 1) * len(outputs) > MOST_PARAMETERS:
            raise ValueError(f"{width} features of {len(outputs)} outputs are beyond the bound of {MOST_PARAMETERS} parameters")
        if keep < 1:
            raise ValueError("a version must be kept")
        self.store, self.features, self.target, self.outputs, self.shape = store, features, target, outputs, (width + 1, len(outputs))
        self.objective, self.optimiser, self.epochs, self.weight, self.keep = objective, optimiser or Optimiser(), epochs, weight, keep

    def model(self) -> Linear | None:
        """The newest complete version."""
        done = self.store.versions()
        return Linear(self.store.read(done[-1]).weights.reshape(self.shape), self.outputs, self.objective) if done else None

    def learn(self, batch: DataFrame, number: int, stream: str = "") -> None:
        """Learns from a batch unless the version of its number is complete; versions of another stream are an error, as their numbers mean other rows."""
        before = None
        done = self.store.versions()
        if done:
            before = self.store.read(max([v for v in done if v < number], default=done[-1]))
            if before.stream != stream:
                raise ValueError(f"the model in {self.store.path} was made by the stream {before.stream!r}, not {stream!r}")
            if done[-1] >= number:
                return
        shape, loss = self.shape, OBJECTIVES[self.objective]
        try:
            rows, width = encoded(batch, self.features, self.target, self.outputs, self.weight)
        except ValueError:
            if batch.where(F.col(self.features).isNotNull() & F.col(self.target).isNotNull()).isEmpty():
                return
            raise
        if width != shape[0] - 1:
            rows.unpersist()
            raise ValueError(f"{width} features where {shape[0] - 1} are learnt")
        n = shape[0] * shape[1]
        if before is None:
            before = Version(-1, stream, 0, 0, 0.0, np.zeros(n), np.zeros(n), np.zeros(n))

        def scored(b, w):
            x = np.hstack([matrix(b, "x"), np.ones((b.num_rows, 1))])
            return x, loss(x @ w.reshape(shape), matrix(b, "y"))

        def gradient(b, w):
            u = b.column("w").to_numpy()
            x, (_, g) = scored(b, w)
            return (x.T @ (g * u[:, None])).ravel(), u.sum()

        def losses(batches, w=before.weights):
            for b in batches:
                if b.num_rows:
                    u = b.column("w").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([float(u.sum())]), pa.array([float(scored(b, w)[1][0] @ u)])], names=["n", "u", "loss"])

        seen = rows.mapInArrow(losses, "n long, u double, loss double").agg(F.sum("n").alias("n"), F.sum("u").alias("u"), F.sum("loss").alias("loss")).first()
        optimiser = copy.copy(self.optimiser)
        optimiser.a, optimiser.b = before.a, before.b
        w = descend(rows, before.weights, gradient, optimiser, self.epochs, done=before.steps)
        rows.unpersist()
        full = [np.broadcast_to(np.asarray(s, float), n) for s in (optimiser.a, optimiser.b)]
        self.store.write(Version(number, stream, before.rows + seen.n, before.steps + self.epochs, float(seen.loss / max(seen.u, 1e-12)), w, *full))
        self.store.keep_last(self.keep)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Learns from the stream as it comes, or from what is there now; ``checkpoint`` is the stream's own folder, shared, and names it in the store."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: self.learn(batch, number, checkpoint))
        return (writer.trigger(availableNow=True) if available_now else writer).start()
