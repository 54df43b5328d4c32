"""Token counts: pieces are counted once per distinct pre-token and summed by per-document frequencies.

Blocks of documents give their distinct pre-tokens, dealt by pre-token to buckets, and
each document's frequencies, which stay with the block.  Where the same pre-token of many blocks
meets, its pieces are counted once; what comes back to a block is one number per
pre-token, joined there to the frequencies and summed, never an id.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import slices

#: A block ends at this many distinct chunks, or (document, pre-token) pairs.
BLOCK_CHUNKS, BLOCK_PAIRS = 250_000, 3_000_000
#: Pre-tokens are dealt to so many buckets; a bucket's blocks meet in wings of so many tasks of the scan, so that no group grows with the corpus.
BUCKETS, WING = 64, 32
#: White space besides ASCII's: a text with any is counted as one piece of text, as it can't be cut at blanks alone.
OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")
#: Blanks and the word after them; the pattern of pre-tokens never crosses such a border.
CHUNK = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Pre-tokens of a chunk of Latin letters.
PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?[^\s\w]+|\s+(?!\S)|\s+")
LATIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pre_tokens(chunk: bytes) -> list[bytes]:
    """The pre-tokens of a chunk; a chunk that holds more than Latin letters, or a special token's bracket, stays whole."""
    s = chunk.decode()
    if "<|" in s or "_" in s or not LATIN.fullmatch(s):
        return [chunk]
    return [p.encode() for p in PRE.findall(s)]


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers below 2**32, compressed, with their number before them."""
    raw = a.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), "<u4")


class _Block:
    """Documents, the distinct pre-tokens of all and the frequencies of each."""

    def __init__(self):
        self.docs, self.sizes = [], []
        self.chunks, self.tokens = {}, {}  # chunk -> number; pre-token -> number
        self.spans = np.zeros(0, np.int64), np.zeros(0, np.int64)  # each chunk's place in parts
        self.parts = np.zeros(0, np.int64)
        self.pairs = []
        self.n_pairs = 0

    def add(self, doc_ids: list, texts: list[bytes | None]):
        seen, index, counts = len(self.chunks), [], []
        chunks = self.chunks
        for t in texts:
            t = t or b""
            some = [t] if OTHER_SPACE.search(t) else CHUNK.findall(t)
            for c in some:
                if c not in chunks:
                    chunks[c] = len(chunks)
            index.extend(map(chunks.__getitem__, some))
            counts.append(len(some))
        new = [pre_tokens(c) for c in list(chunks)[seen:]] if len(chunks) > seen else []
        tokens = self.tokens
        flat = [tokens.setdefault(p, len(tokens)) for ps in new for p in ps]
        lens = np.fromiter(map(len, new), np.int64, len(new))
        self.spans = np.concatenate([self.spans[0], len(self.parts) + np.cumsum(lens) - lens]), np.concatenate([self.spans[1], lens])
        self.parts = np.concatenate([self.parts, np.array(flat, np.int64)])
        first = len(self.docs)
        self.docs.extend(doc_ids)
        self.sizes.extend(0 if t is None else len(t) for t in texts)
        at = np.array(index, np.int64)
        n = self.spans[1][at]
        ends = np.cumsum(n)
        found = self.parts[np.repeat(self.spans[0][at] - ends + n, n) + np.arange(int(n.sum()))]
        doc = np.repeat(np.repeat(np.arange(first, first + len(texts)), counts), n)
        key, freq = np.unique((doc << 32) | found, return_counts=True)
        self.pairs.append((key, freq.astype(np.int32)))
        self.n_pairs += len(key)

    def full(self) -> bool:
        return len(self.chunks) > BLOCK_CHUNKS or self.n_pairs > BLOCK_PAIRS

    def rows(self):
        """(bucket, tokens, lens) of the block's pre-tokens in each bucket, then (-1, None, None, ids, sizes, frequencies)."""
        words = list(self.tokens)
        buckets = np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))
        order = np.argsort(buckets, kind="stable")
        edges = np.searchsorted(buckets[order], np.arange(BUCKETS + 1)).tolist()
        for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                some = [words[i] for i in order[a:b].tolist()]
                yield bucket, b"".join(some), _packed(np.fromiter(map(len, some), np.int64, b - a)), None, None, None
        # frequencies by document; a pre-token is known by its place in the buckets' order
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        key = np.concatenate([k for k, _ in self.pairs])
        doc, token = key >> 32, place[key & 0xFFFFFFFF]
        of_doc = np.bincount(doc, minlength=len(self.docs))
        yield -1, None, None, self.docs, self.sizes, [_packed(of_doc), _packed(token), _packed(np.concatenate([f for _, f in self.pairs]))]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    A pre-token is counted once for each WING tasks of the scan, gigabytes of text, that hold it.
    Null or empty text: zero bytes and tokens.  Repeated rows come out as often
    as they went in; ids may be null.  Special tokens' strings inside a text
    count as the tokenizer's default has it.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fields = [("bucket", pa.int32()), ("block", pa.string()), ("wing", pa.int32()), ("tokens", pa.binary()), ("lens", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("freqs", pa.list_(pa.binary()))]
    arrow = pa.schema(fields)
    schema = "bucket int, block string, wing int, tokens binary, lens binary, ids array<long>, sizes array<long>, freqs array<binary>"

    def blocks(batches):
        part, nth, block = TaskContext.get().partitionId(), 0, _Block()

        def out():
            held = [(r[0], f"{part}-{nth}", part // WING, *r[1:]) for r in block.rows()]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), arrow)], schema=arrow)

        for b in slices(batches):
            block.add(b.column("doc_id").to_pylist(), [None if t is None else t.encode() for t in b.column("text").to_pylist()])
            if block.full():
                yield out()
                nth, block = nth + 1, _Block()
        if block.docs:
            yield out()

    def counted(key, table):
        """The pieces of each distinct pre-token of the bucket, once, for every block that has it; frequencies go past."""
        if key[0].as_py() < 0:
            return table.select(["bucket", "block", "ids", "sizes", "freqs"]).append_column("pieces", pa.nulls(len(table), pa.binary()))
        lens = [_unpacked(x.as_py()) for x in table.column("lens")]
        texts = []
        for x, n in zip(table.column("tokens"), lens):
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            texts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), x.as_buffer()]))
        coded = pa.chunked_array(texts, pa.large_binary()).combine_chunks().dictionary_encode()
        distinct, tokenizer = coded.dictionary, _tokenizer(tokenizer_path)
        pieces = np.empty(len(distinct), np.int64)
        for i in range(0, len(distinct), 10_000):
            some = [w.decode() for w in distinct.slice(i, 10_000).to_pylist()]
            pieces[i : i + len(some)] = [len(e) for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        every = pieces[coded.indices.to_numpy()]
        ends = np.cumsum([len(n) for n in lens]).tolist()
        none = pa.nulls(len(table), pa.list_(pa.int64()))
        found = pa.array([_packed(every[e - len(n) : e]) for e, n in zip(ends, lens)], pa.binary())
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "ids": none, "sizes": none, "freqs": pa.nulls(len(table), pa.list_(pa.binary())), "pieces": found})

    def summed(table):
        """A block's documents: their frequencies times the pieces, added up."""
        table = table.sort_by("bucket")  # the documents first, then the buckets in order
        pieces = np.concatenate([np.zeros(0, np.int64), *[_unpacked(x.as_py()) for x in table.column("pieces") if x.is_valid]]).astype(np.int64)
        of_doc, token, freq = map(_unpacked, table.column("freqs")[0].as_py())
        n = np.bincount(np.repeat(np.arange(len(of_doc)), of_doc), pieces[token] * freq, len(of_doc)).astype(np.int64)
        return pa.table({"doc_id": table.column("ids")[0].values, "n_bytes": table.column("sizes")[0].values, "n_tokens": n, "over_limit": n > limit})

    dealt = rows.mapInArrow(blocks, schema)
    # the documents' own rows go past the buckets, spread by block
    part = F.when(F.col("bucket") < 0, F.xxhash64("block")).otherwise(F.lit(0))
    partial = dealt.groupBy("bucket", "wing", part.alias("part")).applyInArrow(counted, "bucket int, block string, ids array<long>, sizes array<long>, freqs array<binary>, pieces binary")
    return partial.groupBy("block").applyInArrow(summed, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
