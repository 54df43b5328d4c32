"""Models that are written, read and made again from their record.

``train`` runs a registered trainer on tables that are named by where they lie, and records trainer, options, and each table's schema, rows and hash.
A written model is a folder: ``arrays`` (numbers of its parameters), ``table=i`` (parameters that are tables, which never pass through the driver), ``learner=i`` (Spark ML
pipelines), ``features`` and ``outputs``, and last ``record``, without which the folder isn't a model.  Nothing is pickled: reading makes only the classes listed here.
``reproduce`` trains again by the record and tells what differs: the data, features and outputs of one side only, and parameters.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.param import Param
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import baselines, cart, crf, dual_kernel, factorisation, hdbscan, kernel, linear, mixtures, models, sparse_linear, trees, wide
from skarn.operators.provenance import data_record, differences, run_record


def _sparse(df: DataFrame, names: list[str], target: str, method: str = "elastic_net", weight: str | None = None, **options) -> dict[str, float]:
    fit = {"elastic_net": sparse_linear.elastic_net, "forward_selection": sparse_linear.forward_selection, "lars": sparse_linear.lars}[method]
    return fit(sparse_linear.Moments(df, names, target, weight), **options)


def _independent_sparse(df: DataFrame, names: list[str], targets: list[str], method: str = "elastic_net", weight: str | None = None, **options) -> dict[str, dict[str, float]]:
    """Sparse weights for each target by itself."""
    return {t: _sparse(df, names, t, method, weight, **options) for t in targets}


#: What can be trained by name: functions of tables and options that give a model.
TRAINERS = {
    "linear": linear.fit,
    "wide_linear": wide.fit,
    "kernel_landmarks": kernel.fit,
    "kernel_exact": dual_kernel.fit,
    "factorisation_machine": factorisation.fit,
    "conditional_random_field": crf.fit,
    "extra_trees": trees.fit,
    "split_trees": cart.fit,
    "mixture": mixtures.fit,
    "hdbscan": hdbscan.fit,
    "naive_bayes": baselines.mnb_fit,
    "sparse_linear": _sparse,
    "independent_sparse_linear": _independent_sparse,
    "classifier": models.classifier,
    "regressor": models.regressor,
    "independent_regressors": models.independent_regressors,
    "independent_multilabel": models.independent_multilabel,
    "classifier_chain": models.classifier_chain,
    "chain_ensemble": models.chain_ensemble,
    "bagging": models.bagging,
    "samme": models.samme,
    "kmeans": models.kmeans,
}

#: The classes whose objects are written and read.
CLASSES = {
    f"{c.__module__.rpartition('.')[2]}.{c.__name__}": c
    for c in (linear.Linear, linear.Optimiser, wide.Wide, kernel.KernelModel, dual_kernel.DualModel, factorisation.FactorisationMachine, crf.Crf, trees.ExtraTrees, cart.Trees, mixtures.Mixture, hdbscan.Model, hdbscan.Exemplars, models.Regressors, models.Relevance, models.Chain, models.Chains, models.Combined)
}


@dataclass(frozen=True)
class Source:
    """A table by where it lies: a format and path that all executors read, SQL expressions of its columns and a condition."""

    path: str
    columns: tuple[str, ...] = ("*",)
    where: str | None = None
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        df = spark.read.format(self.format).options(**self.options).load(self.path)
        return (df.where(self.where) if self.where else df).selectExpr(*self.columns)


@dataclass
class Trained:
    """``record``: the run (trainer, options, data) and its sources; ``features``: (feature), ``outputs``: (output), as the data has them."""

    model: object
    record: dict
    features: DataFrame
    outputs: DataFrame


class _Parts:
    """What a value is made of besides JSON."""

    def __init__(self):
        self.arrays, self.tables, self.learners = [], [], []

    def pack(self, v):
        if v is None or isinstance(v, (bool, str, int, float)):
            return v
        if isinstance(v, np.generic):
            return v.item()
        if isinstance(v, list):
            return [self.pack(x) for x in v]
        if isinstance(v, tuple):
            return {"tuple": [self.pack(x) for x in v]}
        if isinstance(v, dict):
            return {"dict": [[self.pack(k), self.pack(x)] for k, x in v.items()]}
        if isinstance(v, np.ndarray) and v.dtype.kind in "bif":
            self.arrays.append(v)
            return {"array": len(self.arrays) - 1, "shape": list(v.shape), "type": v.dtype.str, "sha256": hashlib.sha256(np.ascontiguousarray(v).tobytes()).hexdigest()}
        if isinstance(v, DataFrame):
            self.tables.append(v)
            return {"table": len(self.tables) - 1}
        if isinstance(v, PipelineModel):
            self.learners.append(v)
            return {"learner": len(self.learners) - 1}
        for name, c in CLASSES.items():
            if type(v) is c:
                return {"of": name, "state": {k: self.pack(x) for k, x in vars(v).items()}}
        raise TypeError(f"{type(v).__name__} can't be written")

    def unpack(self, v):
        if isinstance(v, list):
            return [self.unpack(x) for x in v]
        if not isinstance(v, dict):
            return v
        if "tuple" in v:
            return tuple(self.unpack(x) for x in v["tuple"])
        if "dict" in v:
            return {self.unpack(k): self.unpack(x) for k, x in v["dict"]}
        if "array" in v:
            return self.arrays[v["array"]].astype(v["type"]).reshape(v["shape"])
        if "table" in v:
            return self.tables[v["table"]]
        if "learner" in v:
            return self.learners[v["learner"]]
        made = object.__new__(CLASSES[v["of"]])
        made.__dict__.update({k: self.unpack(x) for k, x in v["state"].items()})
        return made


def _features(tables: dict[str, DataFrame], options: dict) -> DataFrame:
    """The features of the data: listed names, names of long rows, or places in a vector."""
    df = next(iter(tables.values()))
    if "names" in options:
        return df.sparkSession.createDataFrame([(n,) for n in options["names"]], "feature string")
    if {"name", "value"} <= set(df.columns):
        return df.where("name IS NOT NULL").select(F.col("name").cast("string").alias("feature")).distinct()
    vector = options.get("features") or options.get("vector") or next((n for n, t in df.dtypes if t.startswith("array<")), None)
    if vector is None or not dict(df.dtypes)[vector].startswith("array<"):
        return df.sparkSession.createDataFrame([], "feature string")
    v = F.flatten(vector) if dict(df.dtypes)[vector].startswith("array<array<") else F.col(vector)
    width = F.size(F.get(vector, F.lit(0))) if dict(df.dtypes)[vector].startswith("array<array<") else F.size(v)
    return df.agg(F.max(width).alias("n")).where("n > 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i.cast("string"))).alias("feature"))


def _outputs(tables: dict[str, DataFrame], options: dict) -> DataFrame:
    """The distinct labels of the data; none where what is learnt are numbers."""
    for df in tables.values():
        for name in (options.get(k) for k in ("target", "label", "labels_col", "output")):
            kind = dict(df.dtypes).get(name) if isinstance(name, str) else None
            if kind in ("string", "array<string>"):
                values = df.select(F.explode(name) if kind.startswith("array") else F.col(name)).toDF("output")
                return values.where("output IS NOT NULL").distinct()
    return next(iter(tables.values())).sparkSession.createDataFrame([], "output string")


def train(spark: SparkSession, trainer: str, tables: dict[str, Source], **options) -> Trained:
    """Runs a trainer of ``TRAINERS``; ``tables`` by the names of its arguments.  Options are plain values, arrays or objects of ``CLASSES``."""
    if trainer not in TRAINERS:
        raise ValueError(f"no trainer {trainer!r}: there are {', '.join(TRAINERS)}")
    parts = _Parts()
    packed = {k: parts.pack(v) for k, v in sorted(options.items())}  # before the trainer sees them: optimisers change as they step
    if parts.tables or parts.learners:
        raise TypeError("tables are given as sources, and models that hold tables can't be options")
    read = {k: s.read(spark) for k, s in tables.items()}
    inputs = [data_record(df, k) for k, df in read.items()]
    record = {"run": run_record(trainer, packed, inputs, options.get("seed")), "sources": {k: asdict(s) for k, s in tables.items()}}
    fresh = {k: parts.unpack(v) for k, v in packed.items()}
    record = json.loads(json.dumps(record | {"option_arrays": [a.ravel().tolist() for a in parts.arrays]}))  # as it is when read
    return Trained(TRAINERS[trainer](**read, **fresh), record, _features(read, options), _outputs(read, options))


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save(trained: Trained, path: str) -> None:
    """Writes a model to a folder that isn't there yet; one that a failed writer left without its record is written anew."""
    spark, path = trained.features.sparkSession, path.rstrip("/")
    fs, at = _folder(spark, f"{path}/record/_SUCCESS")
    if fs.exists(at):
        raise ValueError(f"{path} holds a model")
    parts = _Parts()
    state = parts.pack(trained.model)
    held = [(i, np.arange(a.size), a.ravel()) for i, a in enumerate(parts.arrays)]
    numbers = pa.table(
        {
            "array": np.concatenate([np.full(a.size, i, np.int32) for i, _, a in held] or [np.zeros(0, np.int32)]),
            "at": np.concatenate([at for _, at, _ in held] or [np.zeros(0, np.int64)]),
            "real": pa.concat_arrays([pa.array(a.astype(float)) if a.dtype.kind == "f" else pa.nulls(a.size, pa.float64()) for *_, a in held] or [pa.nulls(0, pa.float64())]),
            "whole": pa.concat_arrays([pa.nulls(a.size, pa.int64()) if a.dtype.kind == "f" else pa.array(a.astype(np.int64)) for *_, a in held] or [pa.nulls(0, pa.int64())]),
        }
    )
    spark.createDataFrame(numbers).write.mode("overwrite").parquet(f"{path}/arrays")
    for i, t in enumerate(parts.tables):
        t.write.mode("overwrite").parquet(f"{path}/table={i}")
    for i, m in enumerate(parts.learners):
        m.write().overwrite().save(f"{path}/learner={i}")
    trained.features.write.mode("overwrite").parquet(f"{path}/features")
    trained.outputs.write.mode("overwrite").parquet(f"{path}/outputs")
    body = {"record": trained.record, "state": state, "arrays": len(parts.arrays), "tables": len(parts.tables), "learners": len(parts.learners)}
    marked = spark.createDataFrame([(json.dumps(body),)], "body string").coalesce(1).write.mode("overwrite")
    marked.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/record")


def load(spark: SparkSession, path: str) -> Trained:
    """Reads a written model; a folder without a whole record is an error."""
    path = path.rstrip("/")
    fs, at = _folder(spark, f"{path}/record/_SUCCESS")
    if not fs.exists(at):
        raise ValueError(f"{path} holds no model")
    body = json.loads(spark.read.parquet(f"{path}/record").first().body)
    t = spark.read.parquet(f"{path}/arrays").orderBy("array", "at").toArrow()
    parts, of = _Parts(), t.column("array").to_numpy()
    for i in range(body["arrays"]):
        some = t.filter(pa.array(of == i))
        parts.arrays.append((some.column("whole") if some.num_rows and some.column("real").null_count else some.column("real")).to_numpy())
    parts.tables = [spark.read.parquet(f"{path}/table={i}") for i in range(body["tables"])]
    parts.learners = [PipelineModel.load(f"{path}/learner={i}") for i in range(body["learners"])]
    return Trained(parts.unpack(body["state"]), body["record"], spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/outputs"))


#: What Spark ML's stages have learnt, by the names of its attributes.
_LEARNT = ("labels", "coefficientMatrix", "interceptVector", "coefficients", "intercept", "factors", "linear", "scale", "weights")


def _stage(stage) -> dict:
    out = {"kind": type(stage).__name__}
    if hasattr(stage, "models"):
        return out | {str(i): _stage(m) for i, m in enumerate(stage.models)}
    if hasattr(stage, "toDebugString"):
        return out | {"trees": stage.toDebugString.partition("\n")[2]}
    if hasattr(stage, "clusterCenters"):
        return out | {"centres": np.array(stage.clusterCenters())}
    for name in _LEARNT:
        try:
            v = getattr(stage, name)
        except Exception:  # a binary model's matrix, say, which a model of many labels has and this one hasn't
            continue
        if isinstance(v, Param):  # a stage without training, whose settings are in the options
            continue
        out[name] = np.asarray(v.toArray() if hasattr(v, "toArray") else v)
    return out


def _rows(df: DataFrame, digits: int) -> DataFrame:
    rounded = {"double": lambda c: F.round(c, digits), "float": lambda c: F.round(c, digits), "array<double>": lambda c: F.transform(c, lambda v: F.round(v, digits))}
    return df.select(*[rounded.get(t, lambda c: c)(F.col(f"`{n}`")).alias(n) for n, t in df.dtypes])


def parameter_differences(a, b, rtol: float = 1e-9, digits: int = 9, place: str = "model") -> list[tuple[str, str]]:
    """(place, what differs) between two models: numbers beyond ``rtol`` (of the greatest of their array), rows of tables, rounded to ``digits``, on one side only."""
    if isinstance(a, PipelineModel) and isinstance(b, PipelineModel):
        a, b = ({str(i): _stage(s) for i, s in enumerate(m.stages)} for m in (a, b))
    if type(a) is not type(b) and not all(isinstance(v, (int, float)) for v in (a, b)):
        return [(place, f"{type(a).__name__} and {type(b).__name__}")]
    if isinstance(a, DataFrame):
        x, y = _rows(a, digits), _rows(b, digits)
        if x.columns != y.columns:
            return [(place, f"columns {x.columns} and {y.columns}")]
        gone, new = x.exceptAll(y).count(), y.exceptAll(x).count()
        return [(place, f"{gone} rows only before, {new} only after")] if gone or new else []
    if isinstance(a, np.ndarray):
        if a.shape != b.shape:
            return [(place, f"shapes {a.shape} and {b.shape}")]
        if a.dtype.kind not in "bif":
            return [] if (a == b).all() else [(place, "values")]
        far = float(np.abs(a.astype(float) - b.astype(float)).max(initial=0.0))
        return [] if far <= rtol * max(1.0, float(np.abs(a.astype(float)).max(initial=0.0))) else [(place, f"numbers by {far:.6g}")]
    if isinstance(a, (list, tuple)):
        if len(a) != len(b):
            return [(place, f"{len(a)} and {len(b)} items")]
        return [d for i, (x, y) in enumerate(zip(a, b)) for d in parameter_differences(x, y, rtol, digits, f"{place}[{i}]")]
    if isinstance(a, dict):
        return [d for k in sorted({*a, *b}, key=str) for d in ([(f"{place}[{k}]", "only before" if k in a else "only after")] if (k in a) != (k in b) else parameter_differences(a[k], b[k], rtol, digits, f"{place}[{k}]"))]
    if type(a) in CLASSES.values():
        return parameter_differences(vars(a), vars(b), rtol, digits, place)
    if isinstance(a, float) or isinstance(b, float):
        same = a == b or (np.isnan(a) and np.isnan(b)) or abs(a - b) <= rtol * max(1.0, abs(a))
        return [] if same else [(place, f"{a} and {b}")]
    return [] if a == b else [(place, f"{a} and {b}")]


@dataclass
class Reproduction:
    """The model made again; (path, before, after) of records; (place, what) of parameters; (feature, side) and (output, side) of those on one side only."""

    trained: Trained
    record: list[tuple[str, object, object]]
    parameters: list[tuple[str, str]]
    features: DataFrame
    outputs: DataFrame

    def same(self) -> bool:
        return not self.record and not self.parameters and self.features.isEmpty() and self.outputs.isEmpty()


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


def retrain(spark: SparkSession, record: dict) -> Trained:
    """Trains by a record alone, on what its sources hold now."""
    parts = _Parts()
    parts.arrays = [np.array(a) for a in record["option_arrays"]]
    options = {k: parts.unpack(v) for k, v in record["run"]["options"].items()}
    sources = {k: Source(**(s | {"columns": tuple(s["columns"])})) for k, s in record["sources"].items()}
    return train(spark, record["run"]["operator"], sources, **options)


def reproduce(spark: SparkSession, path: str, rtol: float = 1e-9) -> Reproduction:
    """Trains a written model again and compares."""
    old = load(spark, path)
    new = retrain(spark, old.record)
    return Reproduction(new, differences(old.record, new.record), parameter_differences(old.model, new.model, rtol), _sides(old.features, new.features), _sides(old.outputs, new.outputs))
