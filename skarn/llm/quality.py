"""Quality of texts by positive-unlabelled learning with the non-negative unbiased risk (Kiryo et al., 2017).

Trusted are only positives; everything else is unlabelled web text, a mixture of positives (a share pi,
the class prior) and of negatives that nobody has marked.  With the logistic loss l the risk of a classifier z is

    pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)])

whose second part estimates what negatives cost; it can't be below zero, and where a fit drives it there, the step goes back.
The prior is estimated too, by the best bin (Garg et al., 2021): above a threshold where only positives are left,
the unlabelled share divided by the positive share is pi.

A text is told by its form: what kinds of characters stand beside each other, how long and how varied its words,
pairs of words and lines are.  These numbers are computed once a text, in one pass, and all else reads them alone.
Every round of the fit is one pass of partial sums; the driver holds a matrix of the features' number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import folded, release, slices, written

#: Kinds of characters: blank, line end, letter, capital, digit, sentence mark, anything else; the last stands at both ends of a text.
KINDS, BLANK, LINE, LETTER, CAPITAL, DIGIT, MARK, OTHER, END = 8, 0, 1, 2, 3, 4, 5, 6, 7
MARKS = ".,;:!?'\"()-"
#: Pairs of kinds, and the statistics of words, pairs of words and lines after them.
N_STATS = 11
N_FEATURES = KINDS * KINDS + N_STATS
#: Standardised features are held within this.
MOST = 4.0
#: No weight moves by more in a round.
STEP = 1.0
#: Bins of the scores from which the prior is estimated, and the range of z that they span.
BINS, SPAN = 2000, 20.0


def _kind(c: str) -> int:
    if c == "\n":
        return LINE
    if c.isspace():
        return BLANK
    if c.isalpha():
        return CAPITAL if c.isupper() else LETTER
    if c.isdigit():
        return DIGIT
    return MARK if c in MARKS else OTHER


def _runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], member.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hashes(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of x[first:last], by powers of an odd number."""
    if not len(first):
        return np.empty(0, np.uint64)
    there, back = _powers(len(x))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * there, out=total[1:])
    h = (total[last] - total[first]) * back[first]  # the same run hashes alike wherever it stands
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)  # short runs reach the high bits too
    return h ^ h >> np.uint64(32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    out = []
    for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
        row = np.full(n, base, np.uint64)
        row[:1] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def _variety(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each owner: number of keys, share of distinct ones, share of the commonest.  Keys are told apart within their owner by 64 bits less the owners' own."""
    shift = np.uint64(64 - max(1, int(n).bit_length()))
    both = np.sort(owner.astype(np.uint64) << shift | key >> (np.uint64(64) - shift))
    new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.empty(0, int)
    size, of = np.diff(np.append(new, len(both))), (both[new] >> shift).astype(np.int64)
    count, distinct = np.bincount(owner, minlength=n), np.bincount(of, minlength=n)
    some = np.maximum(count, 1)
    return count, distinct / some, _largest(of, size, n) / some


def _largest(of: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The largest size of each owner, of owners in order."""
    out = np.zeros(n)
    if len(of):
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        out[of[first]] = np.maximum.reduceat(size, first)
    return out


def describe(texts: list[str | None]) -> np.ndarray:
    """The features of texts, a row each; null and empty texts have a row of their own kind, all but the ends zero."""
    n = len(texts)
    lens = np.fromiter((len(t or "") for t in texts), np.int64, n)
    x = np.frombuffer("\0".join([*[t or "" for t in texts], ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum(lens + 1) - 1
    doc = np.repeat(np.arange(n), lens + 1)
    points = np.flatnonzero(np.bincount(x))
    kinds = np.zeros(int(points.max(initial=0)) + 1, np.int32)
    kinds[points] = [_kind(chr(p)) for p in points.tolist()]
    kind = kinds[x]
    kind[end] = END
    before = np.append(np.int32(END), kind[:-1])
    pairs = np.bincount(doc * KINDS**2 + (before * KINDS + kind), minlength=n * KINDS**2).reshape(n, KINDS**2)
    shares = pairs / (lens + 1)[:, None]
    first, last = _runs((kind != BLANK) & (kind != LINE) & (kind != END))
    words, owner = _hashes(x, first, last), doc[first]
    n_words, distinct, commonest = _variety(owner, words, n)
    next_ = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.empty(0, int)
    _, distinct_pairs, commonest_pair = _variety(owner[next_], words[next_] * np.uint64(31) + words[next_ + 1], n)
    letters = np.bincount(owner, last - first, minlength=n)
    first, last = _runs((kind != LINE) & (kind != END))
    n_lines, distinct_lines, _ = _variety(doc[first], _hashes(x, first, last), n)
    longest = _largest(doc[first], last - first, n)
    some = np.maximum(n_words, 1)
    stats = [np.log1p(lens), np.log1p(n_words), letters / some, distinct, commonest, distinct_pairs, commonest_pair, np.log1p(n_lines), distinct_lines, np.log1p(longest), np.log1p(letters / some)]
    return np.column_stack([shares, *stats]).astype(np.float32)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f): the form of every whole text, N_FEATURES numbers; a row in, a row out, whatever repeats or is null."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in slices(batches):
            f = describe(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(f)], names=["doc_id", "f"])

    return rows.mapInArrow(run, "doc_id long, f array<float>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(float)


def expand(f: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """1, the standardised features and their squares."""
    z = np.clip((f - mean) / sd, -MOST, MOST)
    return np.column_stack([np.ones(len(z)), z, z * z])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Quality:
    """A fitted model: how features are standardised, weights, the class prior, and the risk of each round: (estimated cost of positives, of negatives)."""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    prior: float
    risks: list[tuple[float, float]] = field(default_factory=list)


@dataclass
class Sums:
    """What a pass gathers: by side (0 unlabelled, 1 positive) the rows, l(z) and l(-z), and sums of x, s x; over unlabelled rows s(1 - s) x x'."""

    count: np.ndarray
    plus: np.ndarray
    minus: np.ndarray
    x: np.ndarray
    sx: np.ndarray
    hessian: np.ndarray


def _gather(train: DataFrame, mean: np.ndarray, sd: np.ndarray, w: np.ndarray) -> Sums:
    d = len(w)

    def run(batches):
        count, plus, minus = np.zeros(2), np.zeros(2), np.zeros(2)
        x, sx, h = np.zeros((2, d)), np.zeros((2, d)), np.zeros((d, d))
        for b in batches:
            side = b.column("side").to_numpy()
            for i in (0, 1):
                some = np.flatnonzero(side == i)
                for a in range(0, len(some), 4096):
                    phi = expand(_matrix(b.column("f").take(pa.array(some[a : a + 4096]))), mean, sd)
                    z = phi @ w
                    s = _sigmoid(z)
                    count[i] += len(phi)
                    plus[i] += np.logaddexp(0, -z).sum()
                    minus[i] += np.logaddexp(0, z).sum()
                    x[i] += phi.sum(axis=0)
                    sx[i] += s @ phi
                    if not i:
                        h += (phi * (s * (1 - s))[:, None]).T @ phi
        if count.any():
            yield np.concatenate([count, plus, minus, x.ravel(), sx.ravel(), h.ravel()])

    v = folded(train, run, np.add, np.zeros(6 + 4 * d + d * d))
    a, b = 6 + 2 * d, 6 + 4 * d
    return Sums(v[:2], v[2:4], v[4:6], v[6:a].reshape(2, d), v[a:b].reshape(2, d), v[b:].reshape(d, d))


def minimise(train: DataFrame, mean: np.ndarray, sd: np.ndarray, prior: float, start: np.ndarray, rounds: int, ridge: float, beta: float, gamma: float) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(weights, risks by round): Newton steps on the unbiased risk; where the cost of negatives falls below -beta, a step of gamma that raises it.

    The weights of the least non-negative risk (with the ridge) are returned.
    """
    w, best, risks = start, (np.inf, start), []
    for _ in range(rounds):
        s = _gather(train, mean, sd, w)
        positive = prior * s.plus[1] / s.count[1]
        negative = s.minus[0] / s.count[0] - prior * s.minus[1] / s.count[1]
        risks.append((float(positive), float(negative)))
        total = positive + max(0.0, negative) + ridge * (w[1:] @ w[1:]) / 2
        if total < best[0]:
            best = (total, w)
        hold = np.full(len(w), ridge)
        hold[0] = 1e-9
        matrix = s.hessian / s.count[0] + np.diag(hold)
        # l(z) - l(-z) = -z: the positives' part of the unbiased risk is linear, its gradient is constant
        gradient = s.sx[0] / s.count[0] - prior * s.x[1] / s.count[1] + np.append(0.0, ridge * w[1:])
        raised = s.sx[0] / s.count[0] - prior * s.sx[1] / s.count[1]
        step = -np.linalg.solve(matrix, gradient) if negative >= -beta else gamma * np.linalg.solve(matrix, raised)
        size = np.abs(step).max()
        w = w + step * min(1.0, STEP / max(size, 1e-12))
        if size < 1e-3:
            break
    return best[1], risks


def estimate_prior(train: DataFrame, mean: np.ndarray, sd: np.ndarray, w: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled rows, by the best bin of their scores: where (unlabelled share above) / (positive share above) has the least upper bound."""
    edges = np.linspace(-SPAN, SPAN, BINS - 1)

    def run(batches):
        out = np.zeros((2, BINS))
        for b in batches:
            side, z = b.column("side").to_numpy(), expand(_matrix(b.column("f")), mean, sd) @ w
            for i in (0, 1):
                out[i] += np.bincount(np.searchsorted(edges, z[side == i]), minlength=BINS)
        if out.any():
            yield out.ravel()

    counts = folded(train, run, np.add, np.zeros(2 * BINS)).reshape(2, BINS)
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    n = above[:, 0]
    share = above / n[:, None]
    ok = share[1] > 0
    slack = sum(np.sqrt(np.log(4 / delta) / (2 * x)) for x in n)
    ratio, bound = share[0][ok] / share[1][ok], (share[0][ok] + slack) / share[1][ok]
    return float(np.clip(ratio[bound.argmin()], 1e-3, 1.0))


def fit(form: DataFrame, positives: DataFrame, prior: float | None = None, rounds: int = 15, ridge: float = 0.03, beta: float = 0.0, gamma: float = 0.5) -> Quality | None:
    """A model from ``positives`` (ids of trusted rows, column doc_id) and all rows of ``form`` (written features) as unlabelled ones.

    prior: the share of positives among all rows, estimated where it isn't given.  Without a single trusted row there is no model: None.
    """
    trusted = form.where("doc_id IS NOT NULL").join(positives.select("doc_id").distinct(), "doc_id", "left_semi")
    trusted = written(trusted.select("f"), "positives")
    train = form.select("f", F.lit(0).alias("side")).unionByName(trusted.select("f", F.lit(1).alias("side")))

    def moments(batches):
        out = np.zeros((2, N_FEATURES + 1))
        for b in batches:
            f, n = _matrix(b.column("f")), b.column("side").to_numpy() == 0
            out[0] += np.append(f[n].sum(axis=0), n.sum())
            out[1] += np.append((f[n] ** 2).sum(axis=0), (~n).sum())
        yield out.ravel()

    both = folded(train, moments, np.add, np.zeros(2 * N_FEATURES + 2)).reshape(2, -1)
    n, n_trusted = both[:, -1]
    if not n_trusted:
        release(trusted)
        return None
    mean = both[0, :-1] / n
    sd = np.sqrt(np.maximum(both[1, :-1] / n - mean**2, 0))
    sd[sd < 1e-6] = 1.0
    start = np.zeros(1 + 2 * N_FEATURES)
    if prior is None:
        # scores of any lower prior rise with the ratio of the densities, which is all that the bins need
        start, _ = minimise(train, mean, sd, 0.5, start, max(1, rounds // 2), ridge, beta, gamma)
        prior = estimate_prior(train, mean, sd, start)
        start = start * 0
    weights, risks = minimise(train, mean, sd, prior, start, rounds, ridge, beta, gamma)
    release(trusted)
    return Quality(mean, sd, weights, prior, risks)


def score(form: DataFrame, model: Quality | None) -> DataFrame:
    """(doc_id, score): the probability that a text is a positive, of every row; 0.5 where there is no model."""
    if model is None:
        return form.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches):
        for b in batches:
            s = np.round(_sigmoid(expand(_matrix(b.column("f")), model.mean, model.sd) @ model.weights), 12)  # equal texts alike, in batches of any size
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return form.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``, learnt from the trusted ids in ``positives`` (column doc_id) and from all texts.

    Null texts count as empty; empty texts have a score as any other.  Rows that repeat come out as often;
    a null id is scored but never trusted.  Of ``docs`` only the id and the text are read.  No trusted rows: every score is 0.5.
    """
    form = written(features(docs, id_col, text_col), "features")
    out = score(form, fit(form, positives, **options))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
