"""Mixture-controlled packing: deficit round-robin over source queues fills token windows.

Each source is a queue of documents; a document of more than ``segment`` tokens
counts as so many packets.  In each round a queue's deficit grows by its
quantum, its share of a window, and the queue sends packets, whole, as long as its deficit lasts;
what is left is carried to the next round, so over any number of windows a source is off its
target by less than a packet and a quantum.  The rounds' packets, laid end to end without gaps, are cut every
``window`` tokens: only there is a packet cut.  An exhausted queue sends no more; the others go on.

A queue that has been given k quanta has sent the packets that end within k * quantum
tokens of it, so the round of a packet follows from where it ends in its queue.  Places come from
one sort of the packets (numbers, no tokens) by round and source, and running sums over its
ranges: deficits carry over partitions as they do over windows.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skarn.llm.common import flat, if_small, runs, slices, word_edges, written

#: A generation of words that a task remembers; words of the last generation but one are forgotten unless met again.
CACHE_WORDS = 150_000
#: Words that are encoded in one go, and entries at which all is forgotten.
JOINED, MOST_ENTRIES = 512, 1_000_000


def _table(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: Bytes that the tokenizer splits off a letter together, where they end a word; those of special tokens stay.
MARKS = _table(set(string.punctuation.encode()) - set(b"<|>"))
#: Last bytes of ß-ö and ø-ÿ, after the first one.
LATIN_FIRST, LATIN_LAST = 0xC3, _table({*range(0x9F, 0xB7), *range(0xB8, 0xC0)})


def pieces_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of all texts end to end, and each text's number of them: words, lower-cased A-Z, and the marks that end a word after a letter.

    Words of a text that holds what begins a special token keep their case.
    """
    raw, at = flat(column)
    data = np.where((raw - np.uint8(65)) < 26, raw | np.uint8(32), raw)
    if b"<|" in raw.tobytes():
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b"<|" in raw[a:b].tobytes():
                data[a:b] = raw[a:b]
    starts, ends, _ = word_edges(data, at)
    letters = data[(data != 32) & ((data - np.uint8(9)) >= 5)]
    marked = MARKS[data]
    some = np.flatnonzero(marked[ends - 1])
    # where the marks before a word's end begin
    bare = np.append(-1, np.flatnonzero(~marked))
    cuts = bare[np.searchsorted(bare, ends[some]) - 1] + 1
    cuts = cuts[cuts > starts[some]]
    cuts = cuts[((data[cuts - 1] - np.uint8(97)) < 26) | (LATIN_LAST[data[cuts - 1]] & (data[cuts - 2] == LATIN_FIRST))]
    starts, ends = (np.sort(np.concatenate([x, cuts]), kind="stable") for x in (starts, ends))
    edges = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(letters)])
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, at))


class WordIds(dict):
    """Ids of a tokenizer that drops white space and marks the ends of words: piece (bytes) -> number of an entry, a run of ids in a pool.

    Texts are cut at ASCII white space, lower-cased A-Z (the tokenizer does so
    anyway), and before trailing marks that it splits off a letter; each
    distinct piece of a slice of texts is looked up once, and encoded where it is new.
    """

    plain = re.compile("[a-zß-öø-ÿÀ-ÖØ-Þ]+")

    def __init__(self, path: str, end_id: int):
        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        # for words of Latin letters in lower case the normalizer and the splitting pattern change nothing: they are encoded many at a time
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.bare = Tokenizer.from_str(json.dumps(spec))
        self.bare.model._resize_cache(0)
        suffix = spec["model"]["end_of_word_suffix"]
        vocabulary = self.bare.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.end_id = end_id
        self.reset()

    def reset(self):
        self.clear()
        self.old, self.new = {}, []
        self.pool, self.used = np.array([self.end_id], np.uint32), 1
        # entry 0 is the end id alone
        self.starts, self.lens, self.entries = np.zeros(1024, np.int64), np.ones(1024, np.int64), 1

    def __missing__(self, word: bytes) -> int:
        at = self.old.get(word)
        if at is None:
            at = self.entries + len(self.new)
            self.new.append(word)
        self[word] = at
        return at

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words end to end, and each word's number of ids."""
        plain = [i for i, w in enumerate(words) if self.plain.fullmatch(w)]
        ids, lens = [], np.zeros(len(words), np.int64)
        order = []
        for i in range(0, len(plain), JOINED):
            some = plain[i : i + JOINED]
            found = np.array(self.bare.encode_batch_fast([" ".join([words[j] for j in some]).lower()], add_special_tokens=False)[0].ids, np.uint32)
            lens[some] = np.diff(np.flatnonzero(self.last[found]), prepend=-1)
            ids.append(found)
            order += some
        is_plain = np.zeros(len(words), bool)
        is_plain[plain] = True
        other = np.flatnonzero(~is_plain).tolist()
        for j, e in zip(other, self.full.encode_batch_fast([words[j] for j in other], add_special_tokens=False)):
            found = np.array(e.ids, np.uint32)
            lens[j] = len(found)
            ids.append(found)
        order += other
        # back into the words' order
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        place = np.empty(len(words), np.int64)
        place[order] = np.cumsum(lens[order]) - lens[order]
        return flat[runs(place, lens)], lens

    def append(self, ids: np.ndarray, lens: np.ndarray):
        """Puts runs of ids into the pool, an entry each."""
        total, n = len(ids), len(lens)
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + 2 * total, np.uint32)])
        if self.entries + n > len(self.starts):
            more = self.entries + 2 * n
            self.starts, self.lens = (np.concatenate([x[: self.entries], np.zeros(more, np.int64)]) for x in (self.starts, self.lens))
        self.pool[self.used : self.used + total] = ids
        at = slice(self.entries, self.entries + n)
        self.starts[at], self.lens[at] = self.used + np.cumsum(lens) - lens, lens
        self.used += total
        self.entries += n

    def documents(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each closed by the end id, and each text's number of ids; null: empty."""
        if self.entries > MOST_ENTRIES:
            self.reset()
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        words, counts = pieces_of(column)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        if self.new:  # those met for the first time; their entries have been numbered already
            self.append(*self.encoded(b"\n".join(self.new).decode().split("\n")))
            self.new = []
        ends = np.cumsum(counts)
        at = np.insert(numbers[words.indices.to_numpy()], ends, 0)
        lens = self.lens[at]
        per_text = np.add.reduceat(lens, ends - counts + np.arange(len(counts)))
        return self.pool[runs(self.starts[at], lens)], per_text


@lru_cache(2)
def _words(path: str, end_id: int) -> WordIds:
    return WordIds(path, end_id)


def cut(doc: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, window: int):
    """Pieces of packets given by (document, start) in order: neighbours that follow each other in the stream are one, then all are cut at windows' ends.

    Arrays with an element a piece: its document, start, length and place in the stream.
    """
    if not len(doc):
        return doc, start, size, at
    new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + size[:-1]))
    first = np.flatnonzero(new)
    doc, start, at, size = doc[first], start[first], at[first], np.add.reduceat(size, first)
    parts = (at + size - 1) // window - at // window + 1
    i = np.repeat(np.arange(len(at)), parts)
    number = runs(at // window, parts)
    edge = np.maximum(at[i], number * window)
    length = np.minimum(at[i] + size[i], (number + 1) * window) - edge
    return doc[i], start[i] + edge - at[i], length, edge


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    targets: dict[str, float] | None = None,
    window: int = 2048,
    segment: int = 1024,
    end_id: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """Packs every document into windows of ``window`` tokens; one row per piece.

    targets: share of tokens per source in every window; sources not named share
    what is left by their size.  None: each source's own share of all tokens.
    A source with a target of 0 comes after all others.  Sources may be any number: each has its own queue.

    Columns: doc_id, start (of its document's ids before it), length, ids_crc32
    (of the little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset,
    n_padding (what its sequence lacks of ``window``), source and, with_ids, ids (binary, 4 bytes an id).

    Null or empty text: the end id alone.  Null source: a queue of its own.
    Repeated rows are packed once each; ids may be null.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))

    def tokenized(batches):
        block, row, cache = TaskContext.get().partitionId(), 0, _words(tokenizer_path, end_id)
        sent: dict[str | None, int] = {}
        try:
            for batch in slices(batches):
                ids, counts = cache.documents(batch.column("text"))
                narrow = ids.astype(np.uint16) if len(ids) == 0 or ids.max() < 1 << 16 else ids
                ends = np.cumsum(counts)
                at = []
                for s, n in zip(batch.column("source").to_pylist(), counts.tolist()):
                    at.append(sent.get(s, 0))
                    sent[s] = at[-1] + n
                number = np.arange(row, row + batch.num_rows)
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, block, np.int64)), pa.array(number), batch.column("doc_id"), batch.column("source"), pa.array(counts), pa.array(at, pa.int64()), pa.array([narrow[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist())], pa.binary())],
                    names=["block", "row", "doc_id", "source", "n", "at", "ids"],
                )
        finally:
            cache.reset()  # the words go with the task; the worker keeps the tokenizer alone

    ids = written(rows.mapInArrow(tokenized, "block long, row long, doc_id long, source string, n long, at long, ids binary"), "ids")
    queued = ids.groupBy("source", "block").agg(F.sum("n").alias("n")).checkpoint()
    total = queued.agg(F.sum("n")).first()[0] or 0
    # a queue's quantum: its share of a window
    sizes = queued.groupBy("source").agg(F.sum("n").alias("length"))
    share = F.col("length") / max(total, 1)
    if targets:
        named = F.create_map(*[x for s, t in targets.items() for x in (F.lit(s), F.lit(float(t)))])[F.col("source")]
        free = sizes.where(named.isNull()).agg(F.sum("length")).first()[0] or 1
        share = F.coalesce(named, F.lit(max(0.0, 1 - sum(targets.values()))) * F.col("length") / free)
    quanta = sizes.select(F.col("source").alias("of"), F.greatest(share * window, F.lit(window / (1 << 40))).alias("quantum"))
    # each block's place in each queue
    before = F.sum("n").over(Window.partitionBy("source").orderBy("block")) - F.col("n")
    starts = queued.withColumn("base", before).join(quanta, F.col("source").eqNullSafe(F.col("of")))
    starts = starts.select(F.col("block").alias("in_block"), "of", "base", "quantum").checkpoint()
    begins = ids.select("block", "row", "source", "n", "at").join(if_small(starts, 160), (F.col("block") == F.col("in_block")) & F.col("source").eqNullSafe(F.col("of")))
    packets = begins.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(segment).cast("long"))))
    packets = packets.withColumn("size", F.least(F.lit(segment), F.col("n") - F.col("start")))
    packets = packets.withColumn("end", F.col("base") + F.col("at") + F.col("start") + F.col("size"))
    packets = packets.withColumn("round", F.ceil(F.col("end") / F.col("quantum")))
    # running sums along the order of sending: within ranges, then over them
    order = ("round", "source", "end")
    ranged = packets.select("block", "row", "start", "size", *order).repartitionByRange(*order).sortWithinPartitions(*order)

    def running(batches):
        part, held = TaskContext.get().partitionId(), 0
        for b in batches:
            size = b.column("size").to_numpy()
            ends = held + np.cumsum(size)
            held = int(ends[-1]) if len(ends) else held
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part, np.int64)), *[b.column(c) for c in ("block", "row", "start", "size")], pa.array(ends - size)], names=["part", "block", "row", "start", "size", "at"])

    ranged = written(ranged.mapInArrow(running, "part long, block long, row long, start long, size long, at long"), "order")
    parts = ranged.groupBy("part").agg(F.sum("size").alias("sent"))
    parts = parts.select("part", (F.sum("sent").over(Window.orderBy("part")) - F.col("sent")).alias("earlier"))  # a row a partition
    placed = ranged.join(F.broadcast(parts), "part").withColumn("at", F.col("at") + F.col("earlier"))
    placed = placed.groupBy("block", "row").agg(F.array_sort(F.collect_list(F.struct("start", "size", "at"))).alias("packets"))
    whole = ids.select("block", "row", "doc_id", "source", "n", "ids").join(placed, ["block", "row"])

    def pieces(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                yield some_pieces(batch.slice(i, 1024))

    def some_pieces(batch):
        packets = batch.column("packets")
        counts, flat = np.diff(packets.offsets.to_numpy()), packets.flatten()
        doc = np.repeat(np.arange(batch.num_rows), counts)
        doc, start, length, at = cut(doc, *[flat.field(c).to_numpy() for c in ("start", "size", "at")], window)
        n = batch.column("n").to_numpy()
        wide = [np.frombuffer(raw, np.uint16 if len(raw) == 2 * m else np.uint32).astype("<u4").tobytes() for raw, m in zip(batch.column("ids").to_pylist(), n.tolist())]
        parts = [wide[d][4 * a : 4 * (a + m)] for d, a, m in zip(doc.tolist(), start.tolist(), length.tolist())]
        crc = np.fromiter(map(zlib.crc32, parts), np.int64, len(parts))
        rows = pa.array(doc)
        columns = [batch.column("doc_id").take(rows), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[doc]), pa.array(at // window), pa.array(at % window), batch.column("source").take(rows)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        if with_ids:
            columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    packed = whole.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids)
    tail = total % window
    short = (F.col("sequence_id") == total // window) & F.lit(bool(tail and tail & (tail - 1)))  # a power of two needs no padding
    return packed.withColumn("n_padding", F.when(short, F.lit(window - tail)).otherwise(F.lit(0)))
