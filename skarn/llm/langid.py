"""Language ID by hyperdimensional profiles.

Every letter has a random bipolar vector.  A trigram binds its letters' vectors,
each permuted by its place, into one; a document bundles (adds) those of all its
trigrams, a language those of all its documents.  A document gets the language whose prototype has the
highest cosine with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import slices

#: Length of the vectors; languages at most (a bound on what the driver holds: DIM numbers each; more are an error).
DIM, MAX_LANGS = 512, 10_000
UNKNOWN = "und"
#: Trigrams whose vectors of DIM numbers a task keeps; of wider ones fewer, in the same memory.
KEPT = 60_000
#: Bytes of text in a slice and texts that are bundled at once, at DIM numbers a text; numbers in a piece of the dense counts.
SLICE, TEXTS, DENSE = 1 << 20, 2048, 1 << 22


def least_cosine(dim: int = DIM) -> float:
    """A cosine that a text unlike a language hardly reaches: five deviations of the cosine of two random vectors."""
    return 5 / dim**0.5


class Space:
    """The vectors of trigrams, made when first met; a space is the same wherever it is made."""

    def __init__(self, dim: int = DIM):
        self.dim, self.letters = dim, {}
        self.number, self.matrix = {}, np.empty((0, dim), np.int8)  # trigrams met so far and their vectors
        self.code = np.full(0x110000, -1, np.int32)  # code point -> folded code point; 0: no letter; -1: not met yet
        self.code[32] = 0

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.Generator(np.random.PCG64(point)).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
        return self.letters[point]

    def vector(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def fold(self, points: np.ndarray) -> np.ndarray:
        """Letters in lower case, all else a blank (0)."""
        out = self.code[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                low = chr(p).lower()
                self.code[p] = ord(low[0]) if chr(p).isalpha() else 0
            out = self.code[points]
        return out

    def rows(self, grams: list[int]) -> np.ndarray:
        """The vectors of trigrams, one below the other; kept from batch to batch, up to a bound."""
        if len(self.number) + len(grams) > KEPT * DIM // self.dim:
            self.number.clear()
        for g in grams:
            if g not in self.number:
                at = self.number[g] = len(self.number)
                if at >= len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.empty((len(self.matrix) + 1024, self.dim), np.int8)])
                self.matrix[at] = self.vector(g)
        return self.matrix[[self.number[g] for g in grams]].astype(np.float32)

    def profiles(self, texts: list[str | None]):
        """Sparse trigram counts of the texts: texts' numbers, trigrams' numbers and counts; the trigrams that the numbers stand for; which texts have letters.

        A trigram is a letter with its two neighbours, a blank at the ends of a word.
        """
        joined = "  ".join(t or "" for t in texts)
        x = self.fold(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
        doc = np.repeat(np.arange(len(texts)), np.fromiter((len(t or "") + 2 for t in texts), np.int64, len(texts)))[: len(x)]
        at = np.flatnonzero(x)
        letters = np.zeros(len(texts), bool)
        letters[doc[at]] = True
        points = np.flatnonzero(np.bincount(x, minlength=1))
        points = points if len(points) and points[0] == 0 else np.append(0, points)
        k = len(points)
        small = np.zeros(int(points[-1]) + 1, np.int64)
        small[points] = np.arange(k)
        y = np.concatenate([[0], small[x], [0]])
        gram = (y[at] * k + y[at + 1]) * k + y[at + 2]
        key = np.sort(doc[at] * k**3 + gram)
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(new, len(key))).astype(np.float32)
        row, gram = key[new] // k**3, key[new] % k**3
        distinct = np.unique(gram)
        number = np.searchsorted(distinct, gram)
        a, b, c = points[distinct // k**2], points[distinct // k % k], points[distinct % k]
        return row, number, count, a << 42 | b << 21 | c, letters

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' vectors (a row each) and which of them have letters."""
        row, number, count, distinct, letters = self.profiles(texts)
        out = np.zeros((len(texts), self.dim), np.float32)
        step = min(4096, max(256, DENSE // max(1, len(texts))))  # trigrams at a time
        for a in range(0, len(distinct), step):
            some = distinct[a : a + step]
            inside = (number >= a) & (number < a + step)
            dense = np.zeros((len(texts), len(some)), np.float32)
            dense[row[inside], number[inside] - a] = count[inside]
            out += dense @ self.rows(some.tolist())
        return out, letters


def _bounded(batches, dim: int):
    """Slices whose vectors take bounded memory, be the texts long or short."""
    for b in slices(batches, most=SLICE * DIM // dim):
        step = max(1, TEXTS * DIM // dim)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototype vector of each language, from all rows with a language and a letter in the text.

    A document counts by direction, not by length.  Each task adds up its own
    rows; what reaches the driver is one vector a language.  More than MAX_LANGS languages are an error.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def add(batches):
        space, sums = Space(dim), {}
        for b in _bounded(batches, dim):
            vectors, letters = space.bundle(b.column("text").to_pylist())
            size = np.linalg.norm(vectors, axis=1)
            unit = vectors / np.maximum(size, 1e-9)[:, None]
            for i, lang in enumerate(b.column("lang").to_pylist()):
                if letters[i]:
                    sums[lang] = sums.get(lang, 0) + unit[i].astype(np.float64)
        at = [(lang, j, x) for lang, v in sums.items() for j, x in enumerate(v.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*at) if at else ([], [], []), (pa.string(), pa.int32(), pa.float64()))], names=["lang", "i", "x"])

    sums = rows.mapInArrow(add, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    # rounded: sums of doubles depend on the order of the tasks in their last places; one row a language
    vectors = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", F.round("x", 6).alias("x")))).alias("v"))
    for r in vectors.limit(MAX_LANGS + 1).collect():
        out[r.lang] = np.zeros(dim)
        out[r.lang][[c.i for c in r.v]] = [c.x for c in r.v]
    if len(out) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: their prototypes would not fit")
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", id_col: str = "doc_id", dim: int = DIM, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (cosine with the prototype, 0 to 1) of every row, and the columns ``keep``.

    Null text or text without a letter: ``und`` and 0.  No prototypes (nothing to learn from): the same.
    Ties go to the language that sorts first.  Repeated rows come out as often as they went in.
    """
    names = sorted(prototypes)
    base = np.array([prototypes[n] / max(1e-12, np.linalg.norm(prototypes[n])) for n in names], np.float32).reshape(len(names), dim)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])

    def run(batches):
        space = Space(dim)  # goes with the task
        for b in _bounded(batches, dim):
            vectors, letters = space.bundle(b.column("text").to_pylist())
            cosine = vectors @ base.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
            known = letters & (len(names) > 0)
            best = cosine.argmax(axis=1) if names else np.zeros(len(known), int)
            lang = [names[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist())]
            score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0) if names else np.zeros(len(known))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang), pa.array(score.astype(np.float64)), *[b.column(f"keep_{i}") for i in range(len(keep))]], names=["doc_id", "lang_pred", "score", *[f"keep_{i}" for i in range(len(keep))]])

    kinds = ", ".join(["doc_id long, lang_pred string, score double", *[f"keep_{i} {rows.schema[f'keep_{i}'].dataType.simpleString()}" for i in range(len(keep))]])
    out = rows.mapInArrow(run, kinds)
    return out.withColumnsRenamed({f"keep_{i}": c if c not in ("doc_id", "lang_pred", "score") else f"{c}_in" for i, c in enumerate(keep)})
