"""A model learnt from a stream, killed and restarted, against the same batches learnt one after another."""

import copy

import numpy as np
import pytest

from skarn.operators.linear import Optimiser
from skarn.streaming.training import ModelStore, StreamedLinear

SCHEMA = "id long, x array<double>, l string"


def _parts(seed=1, n=60):
    r = np.random.default_rng(seed)
    parts = []
    for p in range(4):
        x = r.normal(size=(n, 3))
        parts.append([(p * n + i, v.tolist(), "a" if v[0] - v[1] > 0 else "b") for i, v in enumerate(x)] + [(-1, None, "a"), (-2, [0.0, 0.0, 0.0], None)])
    return parts


def _plain(parts, epochs, rate=0.5):
    """AdaGrad over the batches' gradients of the logistic loss."""
    w, a, losses = np.zeros((4, 2)), np.zeros((4, 2)), []
    for part in parts:
        known = [(x, label) for _, x, label in part if x is not None and label is not None]
        x, y = np.hstack([np.array([k[0] for k in known]), np.ones((len(known), 1))]), np.array([[k[1] == "a", k[1] == "b"] for k in known], float)
        for e in range(epochs):
            z = np.exp(x @ w)
            p = z / z.sum(axis=1, keepdims=True)
            if e == 0:
                losses.append(-np.log((p * y).sum(axis=1)).mean())
            g = x.T @ (p - y) / len(x)
            a += g * g
            w = w - rate * g / (np.sqrt(a) + 1e-6)
    return w, losses


def _learner(spark, path, **more):
    return StreamedLinear(ModelStore(spark, path), "x", "l", ["a", "b"], 3, optimiser=Optimiser("adagrad", 0.5), epochs=3, **more)


def _feed(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(path)


def _run(learner, spark, source, checkpoint):
    learner.start(spark.readStream.schema(SCHEMA).parquet(source), checkpoint, available_now=True).awaitTermination()


@pytest.mark.parametrize("broken", ["before", "during", "after"])
def test_killed_and_restarted_equals_batches(spark, tmp_path, broken, monkeypatch):
    """The stream dies before a version is written, while it is, or after that and before the batch is marked as done."""
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "model", "checkpoint"))
    parts, learner = _parts(), _learner(spark, store)
    write, failed = ModelStore.write, []

    def failing(self, v):
        if v.number == 2 and not failed:
            failed.append(v.number)
            if broken != "before":
                write(self, v)
            if broken == "during":  # files without the mark of a complete version
                (tmp_path / "model" / "version=2" / "_SUCCESS").unlink()
            raise RuntimeError("killed")
        write(self, v)

    monkeypatch.setattr(ModelStore, "write", failing)
    for i, part in enumerate(parts):
        _feed(spark, part, source)
        if i == 2:
            with pytest.raises(Exception, match="killed"):
                _run(learner, spark, source, checkpoint)
            assert ModelStore(spark, store).versions() == ([0, 1, 2] if broken == "after" else [0, 1])
            learner = _learner(spark, store)  # a new process knows nothing but the folders
        _run(learner, spark, source, checkpoint)
    assert failed == [2] and learner.store.versions() == [0, 1, 2, 3]
    w, losses = _plain(parts, 3)
    np.testing.assert_allclose(learner.model().weights, w, rtol=1e-9)
    history = learner.store.history().orderBy("version").collect()
    assert [(r.rows, r.steps) for r in history] == [(60 * k, 3 * k) for k in range(1, 5)]
    np.testing.assert_allclose([r.loss for r in history], losses, rtol=1e-9)
    assert losses[-1] < losses[0]


def test_versions_batches_and_edges(spark, tmp_path):
    learner = _learner(spark, str(tmp_path / "model"), keep=2)
    assert learner.model() is None and learner.store.versions() == []
    parts = _parts(2)
    frames = [spark.createDataFrame(p, SCHEMA) for p in parts]
    learner.learn(frames[0].where("id < 0"), 0)  # nothing to learn from
    assert learner.model() is None
    for i, f in enumerate(frames):
        learner.learn(f, i + 1)
        learner.learn(frames[0], i + 1)  # the same batch again
    assert learner.store.versions() == [3, 4]
    w, _ = _plain(parts, 3)
    np.testing.assert_allclose(learner.model().weights, w, rtol=1e-9)
    learner.learn(frames[0], 2)  # an old batch whose version is gone
    assert learner.store.versions() == [3, 4]
    with pytest.raises(ValueError, match="stream"):
        learner.learn(frames[0], 9, "another")
    with pytest.raises(ValueError, match="features"):
        learner.learn(spark.createDataFrame([(1, [1.0], "a")], SCHEMA), 9)
    with pytest.raises(ValueError):
        _learner(spark, str(tmp_path / "m"), keep=0)
    adam = StreamedLinear(ModelStore(spark, str(tmp_path / "adam")), "x", "l", ["a", "b"], 3, optimiser=Optimiser("adam", 0.1), epochs=2)
    rest = copy.deepcopy(adam.optimiser)
    for i, f in enumerate(frames):
        adam.learn(f, i)
    assert adam.store.read(3).steps == 8 and np.any(adam.store.read(3).b) and np.isscalar(rest.a) and adam.optimiser.a == 0.0
