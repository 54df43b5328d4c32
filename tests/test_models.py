"""Linear, sparse linear and sequence models, explanations and records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import linear, provenance, sequences, sparse_linear
from skarn.sources import synthetic


@pytest.fixture(scope="module")
def points(spark):
    return synthetic.two_gaussians(spark, 300, second=((4.0, 4.0), 1.0)).withColumn("v", F.array("x", "y")).cache()


@pytest.mark.parametrize("objective,optimiser", [("log", linear.Optimiser("adagrad", 1.0)), ("hinge", linear.Optimiser("adam", 0.3)), ("log", linear.Optimiser("sgd", 0.5, "constant", 0.9)), ("log", linear.Optimiser("rmsprop", 0.1))])
def test_linear_classifier(points, objective, optimiser):
    m = linear.fit(points, "v", "label", ["First", "Second"], objective, optimiser, epochs=12)
    assert m.predict(points, "v").where("prediction = label").count() > 285
    assert [f for _, f, _ in m.top_features(["x", "y"], 2)].count("x") == 2


def test_linear_multilabel_and_regression(spark):
    sets = synthetic.multilabels(spark, 200, ["a", "b"]).withColumn("v", F.array("x0", "x1"))
    m = linear.fit(sets, "v", "labels", ["a", "b"], "binary", linear.Optimiser("adam", 0.3), epochs=15)
    assert m.predict(sets, "v", 0.5).where(F.array_sort("labels") == F.col("prediction")).count() > 180
    line = synthetic.linear_regression(spark, 200, [2.0, -1.0], 3.0, 0.01).withColumn("v", F.array("x0", "x1")).withColumn("t", F.array("y"))
    m = linear.fit(line, "v", "t", ["y"], "squared", linear.Optimiser("sgd", 0.5), epochs=25)
    assert np.allclose(m.weights.ravel(), [2, -1, 3], atol=0.05)
    with pytest.raises(ValueError):
        linear.fit(line.limit(0), "v", "t", ["y"], "squared")


def test_objectives_have_the_gradients_of_their_losses():
    r = np.random.default_rng(1)
    z = r.normal(size=(4, 3))
    for name, f in linear.OBJECTIVES.items():
        y = np.eye(3)[[0, 1, 2, 0]] if name not in ("squared", "absolute", "huber") else r.normal(size=(4, 3)) * 4
        g = f(z, y)[1]
        for i in range(4):
            for j in range(3):
                d = np.zeros_like(z)
                d[i, j] = 1e-6
                assert abs((f(z + d, y)[0].sum() - f(z - d, y)[0].sum()) / 2e-6 - g[i, j]) < 1e-4, name


def test_sparse_linear(spark):
    df = synthetic.linear_regression(spark, 500, [3.0, 0.0, -2.0, 0.0, 0.5], 1.0, 0.1).cache()
    names = [f"x{i}" for i in range(5)]
    m = sparse_linear.Moments(df, names, "y")
    full = sparse_linear.lars(m)
    x = np.array(df.select(*names, F.lit(1.0)).collect())
    best = np.linalg.lstsq(x, np.array(df.select("y").collect()).ravel(), rcond=None)[0]
    assert np.allclose([full[n] for n in names] + [full["bias"]], best, atol=1e-6)
    assert set(sparse_linear.forward_selection(m, 2)) == set(sparse_linear.lars(m, 2)) == {"x0", "x2", "bias"}
    ridge = sparse_linear.elastic_net(m, 0.2, 1.0)
    assert "x1" not in ridge and "x3" not in ridge and 2 < ridge["x0"] < 3
    assert np.allclose([sparse_linear.lars(m, lasso=True).get(n, 0) for n in names], best[:5], atol=1e-6)
    local = sparse_linear.explain(lambda t: t.withColumn("y", F.col("a") * 3 - F.col("c")), {"a": 1.0, "b": 2.0, "c": 0.0}, {"a": 1.0, "b": 1.0, "c": 1.0}, spark, k=2)
    assert set(local) == {"a", "c", "bias"} and abs(local["a"] - 3) < 1e-6


def test_sequences(spark):
    df = synthetic.sequences(spark, 60, 6)
    model = sequences.fit_chain(df, "seq", ["pos"], "feature", "label")
    out = sequences.viterbi(df, model, "seq", ["pos"], "feature")
    assert out.count() == 360 and out.where("prediction = label").count() == 360
    p = sequences.preceding_labels(df.where("seq = 0"), "seq", ["pos"], "label").orderBy("pos").collect()
    assert p[0].prev_1 is None and p[2].history == f"{p[0].label}/{p[1].label}"
    with pytest.raises(ValueError):
        sequences.viterbi(df, model, "seq", ["pos"], "feature", most_rows=1)


def test_records(spark):
    df = spark.range(10)
    a, b = provenance.data_record(df, "t"), provenance.data_record(df.repartition(4), "t")
    assert a == b and a["rows"] == 10
    x, y = provenance.run_record("op", {"k": 1}, [a], 1), provenance.run_record("op", {"k": 2}, [a], 1)
    assert {d[0] for d in provenance.differences(x, y)} == {"id", "options.k"}
    assert "inputs" not in provenance.anonymised(x) and "metrics" in provenance.model_card("m", x, {"f1": 1.0})


def test_learner_queries_take_whole_tables(spark, sf):
    from skarn.plans import learner_queries

    e = learner_queries._points(spark, sf)
    p = e.select(*learner_queries._NAMES).first()
    assert sum(np.size(getattr(p, n).toArray()) if hasattr(getattr(p, n), "toArray") else 1 for n in learner_queries._NAMES) == len(e.first().v) == 64
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert sum(r.n for r in learner_queries.multilabel_relevance(spark, sf).collect()) == users
