"""Linear-chain conditional random fields, trained by gradient over rows that hold a sequence each.

A sequence is an array of feature vectors and an array of labels; sequences are the rows that Spark deals
out, and their gradients add up as those of any linear model.  Inference is Viterbi's for the labels,
forward and backward sums for what each is worth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.operators.linear import Optimiser, descend


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)  # where no labelling is allowed
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def _passes(local: np.ndarray, moves: np.ndarray):
    """(logs of the sums over the labellings that end in each label of each place, of those that go on from there, of all)."""
    n, k = local.shape
    ahead, back = np.empty((n, k)), np.zeros((n, k))
    ahead[0] = local[0]
    for t in range(1, n):
        ahead[t] = local[t] + _log_sum(ahead[t - 1][:, None] + moves, 0)
    for t in range(n - 2, -1, -1):
        back[t] = _log_sum(moves + local[t + 1] + back[t + 1], 1)
    return ahead, back, _log_sum(ahead[-1], 0)


def chain_sums(local: np.ndarray, moves: np.ndarray):
    """(log of the sum over all labellings, marginals by place, marginals of neighbours by place) of local scores (places, labels) and moves (label, next label)."""
    ahead, back, total = _passes(local, moves)
    pairs = np.exp(ahead[:-1, :, None] + moves + (local + back)[1:, None, :] - total)
    return total, np.exp(ahead + back - total), pairs


def chunk_shares(local: np.ndarray, moves: np.ndarray, chunks: list[tuple[int, np.ndarray]]) -> list[float]:
    """The share of all labellings' weight that has the labels of each chunk (its first place, label numbers) in its places: the sums before and after it are those of all labellings."""
    ahead, back, total = _passes(local, moves)
    out = []
    for begin, y in chunks:
        inside = moves[y[:-1], y[1:]].sum() + local[np.arange(begin + 1, begin + len(y)), y[1:]].sum()
        out.append(float(np.exp(ahead[begin, y[0]] + inside + back[begin + len(y) - 1, y[-1]] - total)))
    return out


def spans(labels: list[str]) -> list[tuple[int, int, str]]:
    """(first place, number of places, kind) of the chunks of labels B-kind, I-kind and others: an I that continues nothing of its kind begins a chunk."""
    out: list[tuple[int, int, str]] = []
    for t, label in enumerate(labels):
        mark, _, kind = label.partition("-")
        if mark == "I" and kind and out and out[-1][2] == kind and out[-1][0] + out[-1][1] == t:
            out[-1] = (out[-1][0], out[-1][1] + 1, kind)
        elif mark in ("B", "I") and kind:
            out.append((t, 1, kind))
    return out


def best_path(local: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The labelling of the greatest score."""
    score, came = local[0], []
    for row in local[1:]:
        step = score[:, None] + moves
        came.append(step.argmax(axis=0))
        score = row + step.max(axis=0)
    path = [int(score.argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    return np.array(path[::-1])


def loss_and_gradient(x: np.ndarray, y: np.ndarray, p: np.ndarray, k: int):
    """Negative log likelihood of labels y (numbers) for features x (places, features), and its gradient; parameters are weights, biases and moves."""
    n_in = x.shape[1]
    w, moves = p[: (n_in + 1) * k].reshape(n_in + 1, k), p[(n_in + 1) * k :].reshape(k, k)
    x = np.hstack([x, np.ones((len(x), 1))])
    local = x @ w
    total, single, pairs = chain_sums(local, moves)
    loss = total - local[np.arange(len(y)), y].sum() - moves[y[:-1], y[1:]].sum()
    true = np.zeros_like(single)
    true[np.arange(len(y)), y] = 1
    d_moves = pairs.sum(axis=0)
    np.subtract.at(d_moves, (y[:-1], y[1:]), 1)
    return loss, np.concatenate([(x.T @ (single - true)).ravel(), d_moves.ravel()])


#: Numbers of one step over sequences of one length, which bounds a task's memory.
MOST_AT_ONCE = 4_000_000


def batch_gradient(x: np.ndarray, y: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """The sum of the gradients of sequences of one length: features (sequences, places, features) and label numbers (sequences, places)."""
    m, n, n_in = x.shape
    at_once = max(1, MOST_AT_ONCE // (n * k * k))
    if m > at_once:
        return sum((batch_gradient(x[a : a + at_once], y[a : a + at_once], p, k) for a in range(0, m, at_once)), np.zeros(len(p)))
    w, moves = p[: (n_in + 1) * k].reshape(n_in + 1, k), p[(n_in + 1) * k :].reshape(k, k)
    local = x @ w[:-1] + w[-1]
    ahead, back = np.empty((m, n, k)), np.zeros((m, n, k))
    ahead[:, 0] = local[:, 0]
    for t in range(1, n):
        ahead[:, t] = local[:, t] + _log_sum(ahead[:, t - 1, :, None] + moves, 1)
    for t in range(n - 2, -1, -1):
        back[:, t] = _log_sum(moves + (local[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    total = _log_sum(ahead[:, -1], 1)[:, None, None]
    off = np.exp(ahead + back - total)
    off[np.arange(m)[:, None], np.arange(n), y] -= 1
    d_moves = np.exp(ahead[:, :-1, :, None] + moves + (local + back)[:, 1:, None, :] - total[..., None]).sum(axis=(0, 1))
    np.subtract.at(d_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    flat = off.reshape(m * n, k)
    return np.concatenate([(x.reshape(m * n, n_in).T @ flat).ravel(), flat.sum(axis=0), d_moves.ravel()])


class Crf:
    def __init__(self, parameters: np.ndarray, n_in: int, labels: list[str]):
        self.parameters, self.n_in, self.labels = parameters, n_in, labels

    def predict(self, df: DataFrame, features: str) -> DataFrame:
        """``df`` with ``prediction`` (labels) and ``confidence`` (the marginal of each); null or empty sequences give empty arrays."""
        k, n_in, labels = len(self.labels), self.n_in, self.labels
        w, moves = self.parameters[: (n_in + 1) * k].reshape(n_in + 1, k), self.parameters[(n_in + 1) * k :].reshape(k, k)

        @F.pandas_udf("struct<prediction:array<string>,confidence:array<double>>")
        def run(s):
            import pandas as pd

            out = []
            for x in s:
                if x is None or not len(x):
                    out.append(([], []))
                    continue
                local = np.array([np.asarray(v, float) for v in x]) @ w[:-1] + w[-1]
                path = best_path(local, moves)
                _, single, _ = chain_sums(local, moves)
                out.append(([labels[i] for i in path], single[np.arange(len(path)), path].tolist()))
            return pd.DataFrame(out, columns=["prediction", "confidence"])

        return df.withColumn("_p", run(features)).select(*df.columns, "_p.prediction", "_p.confidence")

    def _scores(self) -> tuple[np.ndarray, np.ndarray]:
        k, n_in = len(self.labels), self.n_in
        return self.parameters[: (n_in + 1) * k].reshape(n_in + 1, k), self.parameters[(n_in + 1) * k :].reshape(k, k)

    def predict_within(self, df: DataFrame, features: str, allowed: str, forbidden: list[tuple[str, str]] | None = None) -> DataFrame:
        """As ``predict``, over the labellings that the rules leave, with ``share``: how likely these are without the rules.

        allowed: an array with the labels that each place may have; null, or an end before the sequence's, leaves all.
        forbidden: pairs of labels that may not follow each other.  Where no labelling is left ``prediction`` and ``confidence`` are null and ``share`` is 0.
        """
        w, moves, labels = *self._scores(), self.labels
        number, ruled = {o: i for i, o in enumerate(labels)}, moves.copy()
        for a, b in forbidden or []:
            ruled[number[a], number[b]] = -np.inf

        @F.pandas_udf("struct<prediction:array<string>,confidence:array<double>,share:double>")
        def run(s, rules):
            import pandas as pd

            out = []
            for x, rule in zip(s, rules):
                if x is None or not len(x):
                    out.append(([], [], 1.0))
                    continue
                local = np.array([np.asarray(v, float) for v in x]) @ w[:-1] + w[-1]
                within = local.copy()
                for t, some in enumerate(rule[: len(local)] if rule is not None else []):
                    if some is not None:
                        within[t, [i for i, o in enumerate(labels) if o not in set(some)]] = -np.inf
                ahead, back, left = _passes(within, ruled)
                if left == -np.inf:
                    out.append((None, None, 0.0))
                    continue
                path = best_path(within, ruled)
                at = np.arange(len(path))
                out.append(([labels[i] for i in path], np.exp(ahead[at, path] + back[at, path] - left).tolist(), float(np.exp(left - _passes(local, moves)[2]))))
            return pd.DataFrame(out, columns=["prediction", "confidence", "share"])

        return df.withColumn("_p", run(F.col(features).cast("array<array<double>>"), F.col(allowed))).select(*df.columns, "_p.prediction", "_p.confidence", "_p.share")

    def predict_chunks(self, df: DataFrame, features: str) -> DataFrame:
        """``df`` with ``chunks``: those of the best labelling (labels B-kind, I-kind and others), each with how likely all its labels are together."""
        w, moves, labels = *self._scores(), self.labels

        @F.pandas_udf("array<struct<begin:int,length:int,kind:string,confidence:double>>")
        def run(s):
            import pandas as pd

            out = []
            for x in s:
                if x is None or not len(x):
                    out.append([])
                    continue
                local = np.array([np.asarray(v, float) for v in x]) @ w[:-1] + w[-1]
                path = best_path(local, moves)
                found = spans([labels[i] for i in path])
                shares = chunk_shares(local, moves, [(b, path[b : b + n]) for b, n, _ in found])
                out.append([{"begin": b, "length": n, "kind": kind, "confidence": c} for (b, n, kind), c in zip(found, shares)])
            return pd.Series(out)

        return df.withColumn("chunks", run(F.col(features).cast("array<array<double>>")))

    def score_chunks(self, df: DataFrame, features: str, chunks: str) -> DataFrame:
        """``df`` with ``chunk_scores``: how likely each given chunk is, an array of (begin, labels); null for one that leaves the sequence, has no labels or an unknown one."""
        w, moves, number = *self._scores(), {o: i for i, o in enumerate(self.labels)}

        @F.pandas_udf("array<double>")
        def run(s, given):
            import pandas as pd

            out = []
            for x, some in zip(s, given):
                asked = [(int(c["begin"]), list(c["labels"])) if c is not None and not pd.isna(c["begin"]) and c["labels"] is not None else (-1, []) for c in (some if some is not None else [])]  # pandas makes nulls NaN
                size = len(x) if x is not None else 0
                right = [0 <= b and len(y) > 0 and b + len(y) <= size and all(o in number for o in y) for b, y in asked]
                shares = iter([])
                if any(right):
                    local = np.array([np.asarray(v, float) for v in x]) @ w[:-1] + w[-1]
                    shares = iter(chunk_shares(local, moves, [(b, np.array([number[o] for o in y])) for (b, y), ok in zip(asked, right) if ok]))
                out.append([next(shares) if ok else None for ok in right])
            return pd.Series(out)

        return df.withColumn("chunk_scores", run(F.col(features).cast("array<array<double>>"), F.col(chunks)))


def fit(df: DataFrame, features: str, target: str, labels: list[str], optimiser: Optimiser | None = None, epochs: int = 40) -> Crf:
    """Trains on rows with ``features`` (array of arrays of doubles) and ``target`` (array of labels) of one length; other rows and unknown labels take no part.  Feature vectors of different widths are an error.

    A task takes the sequences of one length together.
    """
    number = F.transform(target, lambda l: F.array_position(F.array(*[F.lit(o) for o in labels]), l).cast("int") - 1)
    rows = df.where(F.col(features).isNotNull() & F.col(target).isNotNull()).select(F.col(features).cast("array<array<double>>").alias("x"), number.alias("y"))
    rows = rows.where((F.size("x") > 0) & (F.size("x") == F.size("y")) & F.forall("y", lambda i: i >= 0)).cache()
    first = rows.first()
    if first is None:
        raise ValueError("no rows to learn from")
    n_in, k = len(first.x[0]), len(labels)
    if not rows.where(F.exists("x", lambda v: v.isNull() | (F.size(v) != n_in))).isEmpty():
        rows.unpersist()
        raise ValueError("feature vectors of different widths")

    def gradient(b, p):
        total, places = np.zeros(len(p)), b.column("y").value_lengths().to_numpy()
        starts = np.cumsum(places) - places
        x, y = b.column("x").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_in), b.column("y").flatten().to_numpy()
        for n in np.unique(places).tolist():
            at = starts[places == n][:, None] + np.arange(n)
            total += batch_gradient(x[at], y[at], p, k)
        return total, float(b.num_rows)

    p = descend(rows, np.zeros((n_in + 1) * k + k * k), gradient, optimiser or Optimiser("adam", 0.1), epochs)
    rows.unpersist()
    return Crf(p, n_in, labels)


def sequences_of(df: DataFrame, id_col: str, order: list[str], features: str, label: str) -> DataFrame:
    """One row a sequence, in order: (id, xs, labels); a sequence is what one id holds and must fit a task."""
    return df.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(features).alias("_x"), F.col(label).alias("_l")))).alias("_s")).select(id_col, F.col("_s._x").alias("xs"), F.col("_s._l").alias("labels"))
