"""Every trainer written, read and trained again by its record."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import baselines, hdbscan, linear, saved
from skarn.operators.saved import Source

NAMES = ["x0", "x1"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Points with every kind of target, their long rows, and sequences, as Parquet."""
    at, r = tmp_path_factory.mktemp("saved"), np.random.default_rng(3)
    x = r.normal(size=(60, 2)) + np.repeat([[0, 0], [6, 6], [0, 6]], 20, axis=0)
    rows = []
    for i, (a, b) in enumerate(x.tolist()):
        kinds = [k for k, yes in (("p", a > 3), ("q", b > 3), ("r", i % 5 == 0)) if yes]
        rows.append((i, [a, b], a, b, "uvw"[i // 20], kinds, 2 * a - b + 1, a + b, [2 * a - b, a]))
    schema = "id long, v array<double>, x0 double, x1 double, label string, kinds array<string>, y double, z double, ys array<double>"
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{at}/points")
    long = [(i, n, abs(v)) for i, row in enumerate(x.tolist()) for n, v in zip(("a", "b"), row)]
    spark.createDataFrame(long, "id long, name string, value double").coalesce(2).write.parquet(f"{at}/long")
    chains = [(i, [[float(j % 2), float(i % 3)] for j in range(4)], ["ab"[j % 2] for j in range(4)]) for i in range(12)]
    spark.createDataFrame(chains, "id long, xs array<array<double>>, labels array<string>").coalesce(1).write.parquet(f"{at}/chains")
    return str(at)


LABELS = list("uvw")
POINTS = ("points", ("*",))
#: trainer -> (tables by argument, options, predictions of a model)
CASES = {
    "linear": ({"df": POINTS}, dict(features="v", target="label", outputs=LABELS, epochs=3, optimiser=linear.Optimiser("adam", 0.1)), lambda m, t: m.predict(t["df"], "v").select("id", "prediction")),
    "wide_linear": ({"features": ("long", ("*",)), "targets": ("points", ("id", "array(CAST(label = 'u' AS DOUBLE), CAST(label = 'v' AS DOUBLE), CAST(label = 'w' AS DOUBLE)) AS y", "1.0D AS u"))}, dict(outputs=LABELS, epochs=2), lambda m, t: m.predict(t["features"]).select("id", "prediction")),
    "kernel_landmarks": ({"df": POINTS}, dict(features="v", target="label", outputs=LABELS, landmarks=8, epochs=3, gamma=0.5), lambda m, t: m.predict(t["df"], "v").select("id", "prediction")),
    "kernel_exact": ({"df": POINTS}, dict(features="v", target="label", outputs=LABELS, key="id", epochs=1, gamma=0.5), lambda m, t: m.predict(t["df"], "v").select("id", "prediction")),
    "factorisation_machine": ({"df": POINTS}, dict(features="v", target="label", outputs=LABELS, epochs=3, factors=2), lambda m, t: m.predict(t["df"], "v").select("id", "prediction")),
    "conditional_random_field": ({"df": ("chains", ("*",))}, dict(features="xs", target="labels", labels=["a", "b"], epochs=3), lambda m, t: m.predict(t["df"], "xs").select("id", "prediction")),
    "extra_trees": ({"df": POINTS}, dict(key="id", vector="v", outputs="ys", width=2, members=2, depth=2), lambda m, t: m.predict(t["df"], "v").select("id", "scores")),
    "split_trees": ({"df": POINTS}, dict(vector="v", outputs="ys", width=2, n_outputs=2, depth=2), lambda m, t: m.predict(t["df"], "v").select("id", "scores")),
    "mixture": ({"df": POINTS}, dict(vector="v", k=2, rounds=2, means=np.array([[0.0, 0.0], [6.0, 6.0]])), None),
    "hdbscan": ({"points": POINTS}, dict(id_col="id", vector="v"), lambda m, t: hdbscan.predict(t["points"], m, "id", "v").select("probe", "cluster")),
    "naive_bayes": ({"features": ("long", ("*",)), "labels": ("points", ("id", "label"))}, {}, lambda m, t: baselines.best_label(baselines.mnb_score(t["features"], m))),
    "sparse_linear": ({"df": POINTS}, dict(names=NAMES, target="y", method="lars"), None),
    "independent_sparse_linear": ({"df": POINTS}, dict(names=NAMES, targets=["y", "z"], alpha=0.01), None),
    "classifier": ({"df": POINTS}, dict(names=NAMES, label="label", maxIter=3), lambda m, t: m.transform(t["df"]).select("id", "prediction_label")),
    "regressor": ({"df": POINTS}, dict(names=NAMES, target="y", kind="cart"), lambda m, t: m.transform(t["df"]).select("id", "prediction_y")),
    "independent_regressors": ({"df": POINTS}, dict(names=NAMES, targets=["y", "z"]), lambda m, t: m(t["df"]).select("id", "prediction_y", "prediction_z")),
    "independent_multilabel": ({"df": POINTS}, dict(names=NAMES, labels_col="kinds", labels=["p", "q", "r"], maxIter=3), lambda m, t: m(t["df"]).select("id", "predicted_labels")),
    "classifier_chain": ({"df": POINTS}, dict(names=NAMES, labels_col="kinds", order=["q", "p"], kind="cart"), lambda m, t: m(t["df"]).select("id", "predicted_labels")),
    "chain_ensemble": ({"df": POINTS}, dict(names=NAMES, labels_col="kinds", labels=["q", "p"], members=2, id_col="id", kind="cart"), lambda m, t: m(t["df"])),
    "bagging": ({"df": POINTS}, dict(names=NAMES, output="label", members=2, id_col="id", maxDepth=2), lambda m, t: m(t["df"])),
    "samme": ({"df": POINTS}, dict(names=NAMES, label="label", members=2, id_col="id", maxDepth=1), lambda m, t: m(t["df"])),
    "kmeans": ({"df": POINTS}, dict(names=NAMES, k=3), lambda m, t: m.transform(t["df"]).select("id", "prediction")),
}


def test_all_trainers_have_a_case():
    assert set(CASES) == set(saved.TRAINERS)


def _train(spark, folder, name):
    tables, options, predict = CASES[name]
    sources = {k: Source(f"{folder}/{at}", columns) for k, (at, columns) in tables.items()}
    return saved.train(spark, name, sources, **options), {k: s.read(spark) for k, s in sources.items()}, predict


@pytest.mark.parametrize("name", list(CASES))
def test_written_read_and_made_again(spark, folder, tmp_path, name):
    made, tables, predict = _train(spark, folder, name)
    saved.save(made, f"{tmp_path}/m")
    again = saved.reproduce(spark, f"{tmp_path}/m")
    assert again.same(), (again.record, again.parameters)
    read = saved.load(spark, f"{tmp_path}/m")
    assert read.record == made.record and saved.parameter_differences(made.model, read.model, 0.0) == []
    if predict:
        rows = [sorted(map(str, predict(m, tables).collect())) for m in (made.model, read.model, again.trained.model)]
        assert rows[0] and rows[0] == rows[1] == rows[2]


def test_what_differs(spark, folder, tmp_path):
    """Data that have changed since: rows, features and outputs on one side only, and the parameters."""
    spark.read.parquet(f"{folder}/points").where("label <> 'w'").write.parquet(f"{tmp_path}/points")
    options = dict(features="v", target="label", outputs=LABELS, epochs=2)
    made = saved.train(spark, "linear", {"df": Source(f"{tmp_path}/points")}, **options)
    saved.save(made, f"{tmp_path}/m")
    spark.read.parquet(f"{folder}/points").where("label <> 'u'").withColumn("v", F.concat("v", F.array(F.lit(1.0)))).write.mode("overwrite").parquet(f"{tmp_path}/points")
    found = saved.reproduce(spark, f"{tmp_path}/m")
    assert not found.same() and [p for p, _ in found.parameters] == ["model[weights]"]
    assert {p for p, *_ in found.record} == {"run.id", "run.inputs"}
    assert {tuple(r) for r in found.features.collect()} == {("2", "after")}
    assert {tuple(r) for r in found.outputs.collect()} == {("u", "before"), ("w", "after")}


def test_refusals(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="no trainer"):
        saved.train(spark, "os.system", {})
    made = saved.train(spark, "sparse_linear", {"df": Source(f"{folder}/points", where="id < 50")}, names=NAMES, target="y", method="forward_selection", k=1)
    with pytest.raises(TypeError, match="can't be written"):
        saved.train(spark, "linear", {"df": Source(f"{folder}/points")}, features="v", target="label", outputs=LABELS, optimiser=object())
    saved.save(made, f"{tmp_path}/m")
    with pytest.raises(ValueError, match="holds a model"):
        saved.save(made, f"{tmp_path}/m")
    with pytest.raises(ValueError, match="no model"):
        saved.load(spark, f"{tmp_path}/none")
    body = json.loads(spark.read.parquet(f"{tmp_path}/m/record").first().body)
    assert body["record"]["run"]["inputs"][0]["rows"] == 50
    body["state"] = {"of": "subprocess.Popen", "state": {}}
    spark.createDataFrame([(json.dumps(body),)], "body string").write.mode("overwrite").parquet(f"{tmp_path}/m/record")
    with pytest.raises(KeyError):
        saved.load(spark, f"{tmp_path}/m")


def test_left_without_its_record(spark, folder, tmp_path):
    """A writer that died before the record: the folder is no model, and is written anew."""
    import shutil

    made = saved.train(spark, "sparse_linear", {"df": Source(f"{folder}/points")}, names=NAMES, target="y")
    saved.save(made, f"{tmp_path}/m")
    shutil.rmtree(f"{tmp_path}/m/record")
    with pytest.raises(ValueError, match="no model"):
        saved.load(spark, f"{tmp_path}/m")
    saved.save(made, f"{tmp_path}/m")
    assert saved.load(spark, f"{tmp_path}/m").model == made.model
