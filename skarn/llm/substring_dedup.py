"""Substring dedup by suffix automata over shards of reference passages.

Exact copies of a text are settled by its hash.  Of the other texts, only
passages around an anchor (the least 5-word hash of a window) that at least two texts
share can hold a repeated window, so only they are dealt to shards, by anchor;
equal passages once.  A shard streams its passages in document order through a
suffix automaton of those before: matching statistics of ``window`` words or
more mark the words that a smaller document holds already; then the passage joins the reference.

The references of a corpus against itself grow with it, so an automaton is built
in the task that owns its shard, rather than broadcast; every passage visits one shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import flat, if_small, release, runs, shared_dir, slices, word_edges, written

#: Words of an anchor.
GRAM = 5
#: Anchors of more places than this are dealt by single windows, each distinct one once.
HOT = 256
#: Words of more bytes are hashed one by one.
LONG = 256
_MUL = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


class Automaton:
    """Suffix automaton of a set of word sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]):
        last = 0
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            if (q := nxt[last].get(w)) is not None:  # a sequence before has it
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = cur

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def matching(self, words: list[int]) -> list[int]:
        """For each word, how many words up to it stand together in some sequence."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode().split()


def _word_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of words by where they lie in one buffer: eight bytes after eight, those of all words at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = lens.astype(np.uint64) * _MUL
    some, at, left = np.flatnonzero(lens <= LONG), starts, lens
    if len(some) < len(lens):
        for i in np.flatnonzero(lens > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lens[i]].tobytes())
        at, left = at[some], left[some]
    while len(some):
        out[some] = _mixed(out[some] ^ (eights[at] & _KEEP[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return _mixed(out)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _MUL
        out += h[i : i + n]
    return _mixed(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _digest(text: bytes) -> bytes:
    """128-bit cryptographic hash of a text's words: equal for texts that differ in white space alone."""
    text = text.translate(_BLANKS).strip()
    if b"  " in text:
        text = b" ".join(text.split())
    return hashlib.blake2b(text, digest_size=16).digest()


def _copy_of(digest: bytes) -> int:
    """Half of that hash: tells texts under one id apart."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours, by spans of doubled width."""
    width = 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (span - width)], x[span - width :])


class Slice:
    """Texts of a batch with their words' hashes, and the windows of each with their anchors, all at once."""

    def __init__(self, column: pa.Array, window: int):
        self.data, self.at = flat(column)
        starts, ends, self.counts = word_edges(self.data, self.at)
        #: The texts that have a window, and their first words' places among all words.
        self.texts = np.flatnonzero(self.counts >= window)
        self.first = (np.cumsum(self.counts) - self.counts)[self.texts]
        self.h = _word_hashes(self.data, starts, ends - starts)

    def digests(self) -> list[bytes]:
        """Of the texts that have a window."""
        return [_digest(self.data[a:b].tobytes()) for a, b in zip(self.at[self.texts].tolist(), self.at[self.texts + 1].tolist())]

    def anchored(self, window: int):
        """Runs of windows with one and the same anchor: each run's text (a place in ``texts``), anchor, first and last window (a window is its first word's place).

        The anchor of a window is the gram with the least upper half of its hash, the first of equals.
        """
        if not len(self.texts):
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        grams = _runs(self.h, GRAM)
        low = np.uint64(0xFFFFFFFF)
        least = _least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - GRAM + 1)
        n = self.counts[self.texts] - window + 1
        windows = runs(self.first, n)
        at = (least[windows] & low).astype(np.int64)
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # a window's anchor lies in its own text
        last = np.append(new[1:], len(at)) - 1
        return np.repeat(np.arange(len(n)), n)[new], grams[at[new]], windows[new], windows[last]


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, shards: int | None = None) -> DataFrame:
    """(doc, copy, whole, starts): the windows of ``window`` words of each text that also start in a document with a smaller id.

    copy: 64-bit hash of the text, to tell texts under one id apart; exact copies are told by a cryptographic hash of 128 bits.  whole:
    every window does (an exact copy); else ``starts`` are the first words of those windows.
    Rows with a null id are never marked, nor do they mark others.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} words or more")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())

    def keys(batches):
        for b in slices(batches):
            s = Slice(b.column("text"), window)
            text, anchor, _, _ = s.anchored(window)
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            new = np.append(True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]))[: len(text)]
            text, anchor = text[new], anchor[new]
            edges = np.searchsorted(text, np.arange(len(s.texts) + 1)).astype(np.int32)
            digest = s.digests()
            columns = [b.column("doc").take(pa.array(s.texts)), pa.array(list(map(_copy_of, digest)), pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(edges), pa.array(anchor.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "copy", "digest", "anchors"])

    # one text of each set of exact copies goes on, under its smallest id
    marked = texts.mapInArrow(keys, "doc long, copy long, digest binary, anchors array<long>")
    marked = written(marked, "anchors")
    classes = marked.groupBy("digest").agg(F.min("doc").alias("doc")).checkpoint()
    first = marked.join(if_small(classes, 160), ["digest", "doc"], "left_semi")  # a repeated row only makes more anchors candidates
    shared = first.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").checkpoint()

    def passages(batches):
        """A row for each run of windows with one and the same anchor; built whole columns at a time."""
        for b in slices(batches):
            s = Slice(b.column("text"), window)
            text, anchor, first, last = s.anchored(window)
            if not len(text):
                continue
            n = last - first + window
            symbols = s.h.astype(np.uint32)[runs(first, n)]  # the automaton's alphabet
            # a passage is shorter than two windows: its first, its last and its length tell all its words
            hashes = _runs(s.h, window)
            content = _mixed(hashes[first] * _MUL + hashes[last] + n.astype(np.uint64))
            edges = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
            words = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(symbols)])
            copy = np.array(list(map(_copy_of, s.digests())), np.int64)[text]
            columns = [b.column("doc").take(pa.array(s.texts[text])), pa.array(copy), pa.array(anchor.view(np.int64)), pa.array((first - s.first[text]).astype(np.int32)), words, pa.array(content.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "copy", "anchor", "start", "words", "content"])

    found = texts.mapInArrow(passages, "doc long, copy long, anchor long, start int, words binary, content long")
    found = found.join(if_small(shared, 40), "anchor")

    def keyed(batches):
        """Passages under their anchors; those of hot anchors as single windows, each under its own content."""
        for b in batches:
            hot = pc.greater(b.column("n"), HOT)
            rest = b.filter(pc.invert(hot))
            names = ["doc", "copy", "start", "words", "content", "key"]
            yield pa.RecordBatch.from_arrays([rest.column(c) for c in ("doc", "copy", "start", "words", "content", "anchor")], names=names)
            b = b.filter(hot)
            if b.num_rows:
                out = [[] for _ in range(5)]
                for d, c, s, w in zip(*(b.column(x).to_pylist() for x in ("doc", "copy", "start", "words"))):
                    for i, x in enumerate(_runs(_mixed(np.frombuffer(w, np.uint32).astype(np.uint64) + _MUL), window).view(np.int64).tolist()):
                        for column, v in zip(out, (d, c, s + i, w[4 * i : 4 * (i + window)], x)):
                            column.append(v)
                columns = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, columns[4]], names=names)

    placed = found.select("doc", "copy", "anchor", "n", "start", "words", "content").mapInArrow(keyed, "doc long, copy long, start int, words binary, content long, key long")
    placed = written(placed, "passages")
    # of equal passages the smallest document's stands for all; later ones are repeats throughout
    content = placed.groupBy("key", "content").agg(F.min("doc").alias("first"), F.first("words").alias("words"))
    n_shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = content.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)))

    def stream(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("first", "ascending"), ("content", "ascending")])
        machine, key, group = Automaton(), None, []
        contents, firsts, repeats = [], [], []

        def through(group):
            """Passages of one document: none of them is a reference for the others."""
            for c, d, w in group:
                stats = machine.matching(w)
                contents.append(c)
                firsts.append(d)
                repeats.append([i - window + 1 for i, n in enumerate(stats) if n >= window])
            for (_, _, w), r in zip(group, repeats[-len(group) :]):
                if len(r) < len(w) - window + 1:  # it brings something new
                    machine.add(w)

        for k, d, c, w in zip(*(table.column(n).to_pylist() for n in ("key", "first", "content", "words"))):
            w = np.frombuffer(w, np.int32).tolist()
            if group and (k != key or d != group[0][1]):
                through(group)
                group = []
            if k != key:  # passages share windows only under one anchor
                machine, key = Automaton(), k
            group.append((c, d, w))
        if group:
            through(group)
        return pa.table({"content": pa.array(contents, pa.int64()), "first": pa.array(firsts, pa.int64()), "repeats": pa.array(repeats, pa.list_(pa.int32()))})

    stats = dealt.select("shard", "key", "content", "first", "words").groupBy("shard").applyInArrow(stream, "content long, first long, repeats array<int>")
    places = placed.select("doc", "copy", "start", "content", F.length("words").alias("bytes"))
    joined = places.join(stats, "content")
    every = F.transform(F.sequence(F.lit(0), (F.col("bytes") / 4).cast("int") - window), lambda i: i)
    own = F.when(F.col("doc") > F.col("first"), every).otherwise(F.col("repeats"))
    starts = joined.select("doc", "copy", F.transform(own, lambda i: i + F.col("start")).alias("starts")).where(F.size("starts") > 0)
    starts = starts.groupBy("doc", "copy").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    # exact copies of a text under a smaller id
    copies = marked.select("doc", "copy", "digest").join(classes.select("digest", F.col("doc").alias("first")), "digest").where("doc > first").select("doc", "copy").distinct()
    starts = starts.join(copies, ["doc", "copy"], "left_anti")  # copies go whole: their windows need no list
    marks = starts.withColumn("whole", F.lit(False)).unionByName(copies.select("doc", "copy", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole")))
    marks = written(marks.select("doc", "copy", "whole", "starts"), "marks")
    release(marked, placed)
    return marks


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one blank) of every row.

    A word goes if a window of ``window`` words over it also starts in a
    document with a smaller id; windows are judged on the input.  Null text: no
    words.  Rows with a null id keep all words and count for no other.  Repeated
    rows of one id are no reason to remove.  An empty table gives no rows.
    """
    marks = mark_repeats(docs, id_col, text_col, window)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def hashed(batches):
        for b in slices(batches):
            copy = [None if t is None else _copy_of(_digest(t.encode())) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(copy, pa.int64())], names=["doc_id", "text", "copy"])

    keyed = rows.mapInArrow(hashed, "doc_id long, text string, copy long")
    side = marks.withColumnsRenamed({"doc": "mark_doc", "copy": "mark_copy"})
    joined = keyed.join(side, (F.col("doc_id") == F.col("mark_doc")) & (F.col("copy") == F.col("mark_copy")), "left").select("doc_id", "text", "whole", "starts")

    def remove(batches):
        for b in slices(batches):
            out = []
            for t, whole, starts in zip(b.column("text").to_pylist(), b.column("whole").to_pylist(), b.column("starts")):
                words = words_of(t)
                kept = words
                if whole and len(words) >= window:
                    kept = []
                elif starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    free = np.cumsum(edge)[:-1] == 0
                    kept = [w for w, ok in zip(words, free.tolist()) if ok]
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
