"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Seeds are runs of ``min_match`` tokens that a document shares with a test item.
Items whose seeds could reach the threshold are tiled: the longest common runs are marked first,
no token twice, whatever their order in the document; an item whose tiles cover
enough of it is leaked.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import if_small, slices, written

#: Benchmark text of one broadcast shard, in bytes; more shards are more passes, one after another.
SHARD_BYTES = 8 << 20
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RADIX, _PRIME = 1_000_003, (1 << 61) - 1


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-case words without marks."""
    return TOKEN.findall((text or "").lower().encode())


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each run of k ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + x[i : i + n]
    return out


def _prefix(ids: list[int]) -> list[int]:
    """Running Karp-Rabin hashes: any run's hash comes from two of them."""
    out = [0]
    for x in ids:
        out.append((out[-1] * _RADIX + x + 2) % _PRIME)
    return out


def _starts(marked: list[bool], length: int):
    """Starts of unmarked runs of ``length``."""
    run = 0
    for i, m in enumerate(marked):
        run = 0 if m else run + 1
        if run >= length:
            yield i - length + 1


def tiles(item: list[int], doc: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, document start, length), longest first, no token of either side twice.

    Ids below 0 match nothing.  Each round finds the greatest length at which an
    unmarked run of the item still stands unmarked in the document, by running hashes, and marks all such runs.
    """
    marked_i, marked_d, out = [x < 0 for x in item], [x < 0 for x in doc], []
    hash_i, hash_d = _prefix(item), _prefix(doc)

    def standing(length: int) -> dict[int, list[int]]:
        """Starts in the item, by hash."""
        power, table = pow(_RADIX, length, _PRIME), defaultdict(list)
        for i in _starts(marked_i, length):
            table[(hash_i[i + length] - hash_i[i] * power) % _PRIME].append(i)
        return table

    def matches(length: int, table: dict[int, list[int]]):
        """(document start, item starts of its hash) of the runs that stand in both."""
        power = pow(_RADIX, length, _PRIME)
        for d in _starts(marked_d, length):
            at = table.get((hash_d[d + length] - hash_d[d] * power) % _PRIME)
            if at and item[at[0] : at[0] + length] == doc[d : d + length]:
                yield d, at

    def common(length: int) -> bool:
        table = standing(length)
        return bool(table) and next(matches(length, table), None) is not None

    most = min(len(item), len(doc))
    while most >= min_match and common(min_match):
        low = min_match
        while low < most:  # if a run of some length is common, so are its shorter parts
            middle = (low + most + 1) // 2
            low, most = (middle, most) if common(middle) else (low, middle - 1)
        # each run of the document takes the next of the item's that still stands; a run is passed by once
        passed: dict[int, int] = defaultdict(int)
        free = 0
        for d, at in matches(low, standing(low)):
            if d < free:
                continue
            n = passed[at[0]]
            while n < len(at) and (marked_i[at[n]] or marked_i[at[n] + low - 1]):
                n += 1
            passed[at[0]] = n
            if n < len(at):
                i = at[n]
                marked_i[i : i + low] = marked_d[d : d + low] = [True] * low
                out.append((i, d, low))
                free = d + low
        most = low
    return out


class Index:
    """A shard of test items, by their runs of ``min_match`` tokens."""

    def __init__(self, items: list[tuple[int, list[bytes]]], min_match: int):
        self.k, self.words, self.items = min_match, {}, []
        for item_id, words in items:
            if len(words) >= min_match:
                self.items.append((item_id, np.array([self.words.setdefault(w, len(self.words)) for w in words], np.int64)))
        grams = [_grams(ids, self.k) for _, ids in self.items]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        self.postings = defaultdict(list)
        for n, g in enumerate(grams):
            for i, h in enumerate(g.tolist()):
                self.postings[h].append((n, i))

    def leaks(self, words: list[bytes], threshold: float) -> list[tuple[int, float, int, int]]:
        """(item, coverage, tiles, longest tile) of the items that the document leaks."""
        if not len(self.grams) or len(words) < self.k:
            return []
        get = self.words.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        grams = _grams(ids, self.k)
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        hits = np.flatnonzero(self.grams[at] == grams)
        if not len(hits):
            return []
        # by distinct run: a word repeated without end meets an item's repeats once
        order = hits[np.argsort(grams[hits], kind="stable")]
        first = np.flatnonzero(np.append(True, grams[order][1:] != grams[order][:-1]))
        seeds = defaultdict(lambda: (set(), []))
        for places in np.split(order, first[1:]):
            for n, i in self.postings[int(grams[places[0]])]:
                in_item, in_doc = seeds[n]
                in_item.add(i)
                if not in_doc or in_doc[-1] is not places:
                    in_doc.append(places)
        out = []
        for n, (in_item, in_doc) in sorted(seeds.items()):
            item_id, item = self.items[n]
            covered = {i + j for i in in_item for j in range(self.k)}
            if len(covered) < threshold * len(item):
                continue  # tiles lie within seeds
            near = np.unique(np.concatenate(in_doc)[:, None] + np.arange(self.k))
            gaps = np.flatnonzero(np.diff(near) > 1) + 1
            doc = np.insert(ids[near], gaps, -1).tolist()  # over a gap no run goes
            t = tiles(item.tolist(), doc, self.k)
            share = sum(x[2] for x in t) / len(item)
            if share >= threshold:
                out.append((item_id, share, len(t), max(x[2] for x in t)))
        return out


LEAKS = "array<struct<item_id:bigint,coverage:double,n_tiles:bigint,longest:bigint>>"
_NAMES = ("item_id", "coverage", "n_tiles", "longest")


def _shards(benchmark: DataFrame, item_id: str, item_text: str):
    """The items' table, cut into shards of about SHARD_BYTES of text: a function from a shard's number to its items, and the number of shards."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (SHARD_BYTES // 2)))
    if n > 1:  # each shard reads its own rows only
        items = written(items.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")).repartitionByRange(min(n, 4096), "shard").sortWithinPartitions("shard"), "items")

    def shard(s: int):
        rows = items.where(F.col("shard") == s) if n > 1 else items
        return [(r["id"], tokens_of(r["text"])) for r in rows.select("id", "text").orderBy("id", "text").collect()]

    return shard, n


def _scan(docs: DataFrame, held, min_match: int, threshold: float) -> DataFrame:
    """``docs`` (with a column ``scanned``) and ``found``: the leaks of one shard's items; the index goes with the task."""
    index = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        made = Index(index.value, min_match)
        for b in slices(batches, "scanned"):
            found = [[dict(zip(_NAMES, x)) for x in made.leaks(tokens_of(t), threshold)] for t in b.column("scanned").to_pylist()]
            yield b.append_column("found", pa.array(found, pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest", pa.int64())]))))

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField("found", T._parse_datatype_string(LEAKS))])
    return docs.mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_match: int = 5,
    threshold: float = 0.5,
    out_col: str = "leaks",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, and ``out_col``: array of (item_id, coverage, n_tiles, longest), by item.

    coverage: share of the item's tokens within tiles of ``min_match`` tokens or
    more.  Null or empty texts leak nothing; null, empty and shorter items than
    ``min_match`` tokens can't be leaked; repeated items and rows count one by one.
    A benchmark beyond SHARD_BYTES goes out in shards: each is broadcast, scanned
    for in a pass of its own whose few findings are written, and dropped before the next.
    """
    keep = docs.columns if keep is None else keep
    shard, n_shards = _shards(benchmark, item_id, item_text)
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("scanned"))
    if n_shards == 1:
        out = _scan(numbered, shard(0), min_match, threshold)
    else:
        # what a text leaks depends on the text alone: findings go by its 128-bit hash
        key = F.md5(F.col("scanned").cast("binary"))
        texts, passes = numbered.select("scanned"), []
        for s in range(n_shards):
            found = _scan(texts, shard(s), min_match, threshold).where(F.size("found") > 0).select(key.alias("of"), "found")
            passes.append(written(found.distinct(), "leaks"))
        leaks = passes[0]
        for more in passes[1:]:
            leaks = leaks.unionByName(more)
        leaks = leaks.groupBy("of").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found")).checkpoint()
        out = numbered.join(if_small(leaks, 400), key == F.col("of"), "left").withColumn("found", F.coalesce("found", F.array().cast(LEAKS)))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("found").alias(out_col))


def leaked_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """A row for each test item that a document leaks: doc_id, item_id, coverage, n_tiles, longest."""
    found = find_leaks(docs, benchmark, keep=[id_col], **options)
    return found.select(F.col(id_col).cast("long").alias("doc_id"), F.explode("leaks").alias("x")).select("doc_id", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all their columns, that leak no test item."""
    name = "leaks" if "leaks" not in docs.columns else "leaks_" + "x" * max(map(len, docs.columns))
    return find_leaks(docs, benchmark, out_col=name, **options).where(F.size(name) == 0).drop(name)
