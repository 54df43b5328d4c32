"""Trainers over Spark ML, with one interface: ``fit(df)`` gives a model, ``model.transform(df)`` predictions.

Distributed learning is Spark ML's; what it lacks (SAMME boosting, chains, independent
outputs, combiners) is composed of it, member by member.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    FMClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.baselines import average, multilabel_vote, vote
from skarn.operators.sampling import bootstrap
from skarn.operators.scratch import Scratch

#: What a classifier's pipeline adds to the rows.
_ADDED = ("_label", "_features", "rawPrediction", "probability", "prediction", "prediction_label")

CLASSIFIERS = {
    "logistic": lambda **o: LogisticRegression(**o),
    "linear_svm": lambda **o: OneVsRest(classifier=LinearSVC(**o)),
    "cart": lambda **o: DecisionTreeClassifier(**({"seed": 1, "minInstancesPerNode": 5} | o)),
    "random_forest": lambda **o: RandomForestClassifier(**({"seed": 1} | o)),
    "gbt": lambda **o: OneVsRest(classifier=GBTClassifier(**({"seed": 1} | o))),
    "fm": lambda **o: OneVsRest(classifier=FMClassifier(**({"seed": 1} | o))),
}
REGRESSORS = {
    "linear": lambda **o: LinearRegression(**o),
    "elastic_net": lambda **o: LinearRegression(**({"regParam": 0.1, "elasticNetParam": 0.5} | o)),
    "cart": lambda **o: DecisionTreeRegressor(**({"seed": 1, "minInstancesPerNode": 5} | o)),
    "random_forest": lambda **o: RandomForestRegressor(**({"seed": 1} | o)),
    "gbt": lambda **o: GBTRegressor(**({"seed": 1} | o)),
    "fm": lambda **o: FMRegressor(**({"seed": 1} | o)),
    "huber": lambda **o: LinearRegression(**({"loss": "huber"} | o)),
}


def classifier(df: DataFrame, names: list[str], label: str, kind: str = "logistic", weight: str | None = None, **options):
    """A pipeline model; its ``transform`` adds ``prediction_label``."""
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df)
    base = CLASSIFIERS[kind](**options)
    base.setLabelCol("_label").setFeaturesCol("_features")
    if weight and hasattr(base, "setWeightCol"):
        base.setWeightCol(weight)
    back = IndexToString(inputCol="prediction", outputCol="prediction_label", labels=index.labels)
    return Pipeline(stages=[index, VectorAssembler(inputCols=names, outputCol="_features"), base, back]).fit(df)


def regressor(df: DataFrame, names: list[str], target: str, kind: str = "linear", weight: str | None = None, **options):
    base = REGRESSORS[kind](**options)
    base.setLabelCol(target).setFeaturesCol("_features").setPredictionCol(f"prediction_{target}")
    if weight:
        base.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_features"), base]).fit(df)


@dataclass
class Regressors:
    """One model a dimension; called with a table, it predicts all dimensions."""

    models: list

    def __call__(self, rows: DataFrame) -> DataFrame:
        for m in self.models:
            rows = m.transform(rows).drop("_features")
        return rows


def independent_regressors(df: DataFrame, names: list[str], targets: list[str], kind: str = "linear", **options):
    return Regressors([regressor(df, names, t, kind, **options) for t in targets])


@dataclass
class Relevance:
    """A model or a fixed answer for each label; called with a table, it adds ``predicted_labels``."""

    labels: list[str]
    models: list

    def __call__(self, rows: DataFrame) -> DataFrame:
        for i, m in enumerate(self.models):
            if isinstance(m, bool):
                rows = rows.withColumn(f"_p{i}", F.lit(m))
            else:
                rows = m.transform(rows).withColumn(f"_p{i}", F.col("prediction_label") == "true").drop(*_ADDED)
        labels_of = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_p{i}"), l) for i, l in enumerate(self.labels)])))
        return rows.withColumn("predicted_labels", labels_of).drop(*[f"_p{i}" for i in range(len(self.models))])


def independent_multilabel(df: DataFrame, names: list[str], labels_col: str, labels: list[str], kind: str = "logistic", **options):
    """Binary relevance: one model a label; the prediction is the array of labels that their models give.

    A label that all rows have, or none has, needs no model: it is predicted so.
    """
    has = df.agg(*[f(F.array_contains(labels_col, l).cast("int")).alias(f"{n}{i}") for i, l in enumerate(labels) for n, f in (("low", F.min), ("high", F.max))]).first()
    fit = lambda l: classifier(df.withColumn("_y", F.array_contains(labels_col, l).cast("string")), names, "_y", kind, **options)
    return Relevance(labels, [fit(l) if has[f"low{i}"] != has[f"high{i}"] else has[f"high{i}"] == 1 for i, l in enumerate(labels)])


@dataclass
class Chain:
    """A model for each label of ``order``; called with a table, it adds ``predicted_labels``."""

    order: list[str]
    models: list

    def __call__(self, rows: DataFrame) -> DataFrame:
        for i, m in enumerate(self.models):
            rows = m.transform(rows).withColumn(f"_c{i}", (F.col("prediction_label") == "true").cast("double")).drop(*_ADDED)
        labels_of = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_c{i}") == 1, l) for i, l in enumerate(self.order)])))
        return rows.withColumn("predicted_labels", labels_of).drop(*[f"_c{i}" for i in range(len(self.models))])


def classifier_chain(df: DataFrame, names: list[str], labels_col: str, order: list[str], kind: str = "logistic", **options):
    """Labels in order; each model sees the labels before its own (true ones in training, predicted ones after)."""
    models, train = [], df
    for i, l in enumerate(order):
        inputs = [*names, *[f"_c{j}" for j in range(i)]]
        models.append(classifier(train.withColumn("_y", F.array_contains(labels_col, l).cast("string")), inputs, "_y", kind, **options))
        train = train.withColumn(f"_c{i}", F.array_contains(labels_col, l).cast("double"))
    return Chain(order, models)


@dataclass
class Chains:
    """A label holds if more than half of the chains give it."""

    chains: list[Chain]
    id_col: str

    def __call__(self, rows: DataFrame) -> DataFrame:
        votes = None
        for c in self.chains:
            p = c(rows).select(self.id_col, "predicted_labels")
            votes = p if votes is None else votes.unionByName(p)
        return multilabel_vote(votes, self.id_col, "predicted_labels", len(self.chains))


def chain_ensemble(df: DataFrame, names: list[str], labels_col: str, labels: list[str], members: int, id_col: str, seed: int = 1, **options):
    """Chains in several orders; a label holds if more than half of them give it."""
    draw = random.Random(seed)
    return Chains([classifier_chain(df, names, labels_col, draw.sample(labels, len(labels)), **options) for _ in range(members)], id_col)


@dataclass
class Combined:
    """Members, alike or by their weights: called with a table, it gives the average of ``column`` (regression) or the vote for it."""

    models: list
    weights: list[float] | None
    id_col: str
    column: str
    regression: bool = False

    def __call__(self, rows: DataFrame) -> DataFrame:
        all_rows = None
        for m, a in zip(self.models, self.weights or [1.0] * len(self.models)):
            p = m.transform(rows).select(self.id_col, F.col(self.column).alias("p"), F.lit(a).alias("a"))
            all_rows = p if all_rows is None else all_rows.unionByName(p)
        return (average if self.regression else vote)(all_rows, self.id_col, "p", F.col("a") if self.weights else None)


def bagging(df: DataFrame, names: list[str], output: str, members: int, id_col: str, kind: str = "cart", regression: bool = False, seed: int = 1, **options):
    """Members on bootstraps (copies as weights), combined by vote or average."""
    fit = regressor if regression else classifier
    models = [fit(bootstrap(df, F.col(id_col), seed + i).withColumn("_w", F.col("copies").cast("double")), names, output, kind, weight="_w", **options) for i in range(members)]
    return Combined(models, None, id_col, f"prediction_{output}" if regression else "prediction_label", regression)


def samme(df: DataFrame, names: list[str], label: str, members: int, id_col: str, kind: str = "cart", **options):
    """Multi-class AdaBoost: members see the rows that those before got wrong at a greater weight; stops when one is perfect or no better than chance."""
    k = df.select(label).distinct().count()
    scratch = Scratch(df.sparkSession)
    rows, models, weights = scratch.write(df.withColumn("_w", F.lit(1.0)), "weighted"), [], []
    for _ in range(members):
        m = classifier(rows, names, label, kind, weight="_w", **options)
        wrong = m.transform(rows).select(*rows.columns, (F.col("prediction_label") != F.col(label)).cast("double").alias("_wrong"))
        error = wrong.agg(F.sum(F.col("_w") * F.col("_wrong")) / F.sum("_w")).first()[0]
        if error <= 0:
            models.append(m)
            weights.append(1.0)
            break
        alpha = math.log((1 - error) / error) + math.log(max(k - 1, 1))
        if alpha <= 0:
            break
        models.append(m)
        weights.append(alpha)
        if len(models) == members:
            break
        rows = wrong.withColumn("_w", F.col("_w") * F.exp(alpha * F.col("_wrong"))).drop("_wrong")
        mean = rows.agg(F.avg("_w")).first()[0]
        rows = scratch.write(rows.withColumn("_w", F.col("_w") / mean), "weighted")  # a table for each member: no lineage grows
    return Combined(models, weights, id_col, "prediction_label")


def kmeans(df: DataFrame, names: list[str], k: int, plus_plus: bool = True, iterations: int = 20, seed: int = 1, weight: str | None = None):
    base = KMeans(k=k, initMode="k-means||" if plus_plus else "random", maxIter=iterations, seed=seed, featuresCol="_features")
    if weight:
        base.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_features"), base]).fit(df)


def gaussian_mixture(df: DataFrame, names: list[str], k: int, iterations: int = 50, seed: int = 1):
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_features"), GaussianMixture(k=k, maxIter=iterations, seed=seed, featuresCol="_features")]).fit(df)


def assign(points: DataFrame, centroids: DataFrame, id_col: str, vector: str, centroid_id: str = "cluster", centroid: str = "centroid") -> DataFrame:
    """(id, cluster, distance): the nearest centroid, the first of several.  The centroids (clusters x dimensions) travel with each task as one array."""
    from skarn.functions.vectors import l2

    held = F.broadcast(centroids.agg(F.array_sort(F.collect_list(F.struct(F.col(centroid_id).alias("cluster"), F.col(centroid).alias("c")))).alias("cs")))
    near = F.array_min(F.transform("cs", lambda x: F.struct(F.round(l2(F.col(vector), x["c"]), 12).alias("distance"), x["cluster"].alias("cluster"))))
    return points.crossJoin(held).select(id_col, near.alias("n")).select(id_col, "n.cluster", "n.distance")  # one row on the other side


def centroids(points: DataFrame, cluster: str, vector: str, weight: str | None = None) -> DataFrame:
    """(cluster, centroid): weighted means; summed by dimension as partial aggregates."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = points.select(F.col(cluster).alias("cluster"), w.alias("w"), F.posexplode(vector).alias("i", "x"))
    means = long.groupBy("cluster", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))
