"""Chunks and rules of chain models against all labellings, listed."""

import itertools

import numpy as np
import pytest

from skarn.operators import crf

LABELS = ["B-x", "I-x", "O"]


def _model(seed=3):
    p = np.random.default_rng(seed).normal(size=3 * 3 + 9)
    return crf.Crf(p, 2, LABELS)


def _weights(model, x):
    w, moves = model._scores()
    local = np.hstack([x, np.ones((len(x), 1))]) @ w
    return {s: np.exp(local[np.arange(len(x)), list(s)].sum() + sum(moves[a, b] for a, b in zip(s, s[1:]))) for s in itertools.product(range(3), repeat=len(x))}


def _data(spark):
    r = np.random.default_rng(5)
    return {i: r.normal(size=(n, 2)) for i, n in enumerate([1, 3, 5, 6])}


def test_chunks_against_all_labellings(spark):
    model, data = _model(), _data(spark)
    chunks = {i: [(b, n) for n in range(1, len(x) + 1) for b in range(len(x) - n + 1)] for i, x in data.items()}
    labels = {i: [[LABELS[(b + j) % 3] for j in range(n)] for b, n in c] for i, c in chunks.items()}
    rows = [(i, x.tolist(), [(b, y) for (b, _), y in zip(chunks[i], labels[i])]) for i, x in data.items()]
    rows += [(10, None, [(0, ["O"])]), (11, [], None), (12, data[1].tolist(), [(2, ["O", "O"]), (-1, ["O"]), (0, []), (0, ["none"]), (None, ["O"]), None, (0, ["O"])])]
    df = spark.createDataFrame(rows, "id int, x array<array<double>>, c array<struct<begin:int,labels:array<string>>>")
    got = {r.id: r.chunk_scores for r in model.score_chunks(df, "x", "c").collect()}
    for i, x in data.items():
        whole = _weights(model, x)
        want = [sum(v for s, v in whole.items() if [LABELS[k] for k in s[b : b + n]] == y) / sum(whole.values()) for (b, n), y in zip(chunks[i], labels[i])]
        np.testing.assert_allclose(got[i], want, rtol=1e-9)
    assert got[10] == [None] and got[11] == [] and got[12][:6] == [None] * 6 and 0 < got[12][6] < 1
    found = {r.id: r.chunks for r in model.predict_chunks(df, "x").collect()}
    assert found[10] == [] and found[11] == []
    for i, x in data.items():
        whole = _weights(model, x)
        best = max(whole, key=whole.get)
        assert [(c.begin, c.length, c.kind) for c in found[i]] == crf.spans([LABELS[k] for k in best])
        for c in found[i]:
            part = slice(c.begin, c.begin + c.length)
            assert abs(c.confidence - sum(v for s, v in whole.items() if s[part] == best[part]) / sum(whole.values())) < 1e-9


def test_spans():
    assert crf.spans(["O", "B-x", "I-x", "B-x", "I-y", "I-y", "O", "I-x", "B"]) == [(1, 2, "x"), (3, 1, "x"), (4, 2, "y"), (7, 1, "x")]
    assert crf.spans([]) == []


@pytest.mark.parametrize("forbidden", [[], [("O", "I-x")]])
def test_rules_against_all_labellings(spark, forbidden):
    model, data = _model(8), _data(spark)
    rules = {0: None, 1: [["O"], None, ["B-x", "I-x"]], 2: [None, ["O", "unheard"]], 3: [["B-x"], ["I-x"], ["O"], ["O", "B-x"], None, ["O"], ["beyond"]]}
    rows = [(i, x.tolist(), rules[i]) for i, x in data.items()] + [(10, None, None), (11, data[1].tolist(), [["unheard"]])]
    if forbidden:
        rows.append((12, data[1].tolist(), [["O"], ["I-x"]]))
    df = spark.createDataFrame(rows, "id int, x array<array<double>>, r array<array<string>>")
    got = {r.id: r for r in model.predict_within(df, "x", "r", forbidden).collect()}
    assert got[10].prediction == [] and got[10].share == 1.0
    for none in [11, 12] if forbidden else [11]:
        assert got[none].prediction is None and got[none].confidence is None and got[none].share == 0.0
    for i, x in data.items():
        whole, rule = _weights(model, x), (rules[i] or []) + [None] * len(x)
        left = {s: v for s, v in whole.items() if all(rule[t] is None or LABELS[k] in rule[t] for t, k in enumerate(s)) and not any((LABELS[a], LABELS[b]) in forbidden for a, b in zip(s, s[1:]))}
        best = max(left, key=left.get)
        assert got[i].prediction == [LABELS[k] for k in best]
        assert abs(got[i].share - sum(left.values()) / sum(whole.values())) < 1e-9
        np.testing.assert_allclose(got[i].confidence, [sum(v for s, v in left.items() if s[t] == k) / sum(left.values()) for t, k in enumerate(best)], rtol=1e-9)


def test_gradient_of_sequences_together(spark, monkeypatch):
    r = np.random.default_rng(9)
    p = r.normal(size=3 * 3 + 9)
    for n in (1, 4):
        x, y = r.normal(size=(7, n, 2)), r.integers(0, 3, (7, n))
        want = sum(crf.loss_and_gradient(a, b, p, 3)[1] for a, b in zip(x, y))
        np.testing.assert_allclose(crf.batch_gradient(x, y, p, 3), want, rtol=1e-9, atol=1e-12)
        monkeypatch.setattr(crf, "MOST_AT_ONCE", 40)  # in several steps
        np.testing.assert_allclose(crf.batch_gradient(x, y, p, 3), want, rtol=1e-9, atol=1e-12)
    data = [(r.normal(size=(n, 2)).tolist(), [LABELS[k] for k in r.integers(0, 3, n)]) for n in (1, 3, 3, 5, 1)]
    df = spark.createDataFrame([*data, ([[1.0, 2.0]], ["none"]), (None, ["O"]), ([], [])], "x array<array<double>>, y array<string>")
    p = np.zeros(18)
    optimiser = crf.Optimiser("sgd", 0.3)
    for t in (1, 2):
        g = sum(crf.loss_and_gradient(np.array(x), np.array([LABELS.index(o) for o in y]), p, 3)[1] for x, y in data) / len(data)
        p = p - optimiser.step(g, t)
    np.testing.assert_allclose(crf.fit(df, "x", "y", LABELS, crf.Optimiser("sgd", 0.3), epochs=2).parameters, p, atol=1e-10)
    mixed = df.union(spark.createDataFrame([([[1.0]], ["O"])], df.schema))
    with pytest.raises(ValueError, match="widths"):
        crf.fit(mixed, "x", "y", LABELS)
