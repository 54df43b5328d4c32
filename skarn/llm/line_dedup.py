"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find; one line of each component stays.

Signatures come from one permutation: the hashes of a line's shingles are dealt
to bins and each bin keeps its least (empty bins borrow from others by fixed
probes), so a shingle is hashed once however long the signature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import BROADCAST_BYTES, if_small, release, shared_dir, slices, written
from skarn.llm.components import connected_components

#: Characters of a shingle; bands and rows of the signature (at a similarity of 0.8, 0.998 of pairs meet in a band); similarity that links.
SHINGLE, BANDS, ROWS, SIMILAR = 8, 12, 4, 0.8
#: A band's bucket of more lines is compared in pairs of tiles of about this many.
TILE = 256
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normal_line(line: str) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return " ".join(line.split()).lower()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles end to end and the number of each line's (a line shorter than k is one shingle)."""
    points = np.frombuffer("".join(l.ljust(k, "\0") for l in lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter((max(k, len(l)) for l in lines), np.int64, len(lines))
    n = lens - k + 1
    # by doubling: the hash of a run is that of its first half, times a power, and that of the rest
    h, done, width = None, 0, 1
    part, power = points, int(_MUL)
    while True:
        if k & width:
            h = part if h is None else h[: len(part) - done] * np.uint64(power) + part[done:]
            done += width
        if done == k:
            break
        part = part[: len(part) - width] * np.uint64(power) + part[width:]
        power, width = power * power % (1 << 64), 2 * width
    first = np.cumsum(lens) - lens
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return _mixed(h[at]), n


def band_keys(lines: list[str], k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each line (row) and band (column); lines that share a key in any column are candidates."""
    bins = bands * rows
    h, n = shingle_hashes(lines, k)
    line = np.repeat(np.arange(len(lines), dtype=np.uint64), n)
    value_bits = np.uint64(40)
    bin_of = (h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)
    key = np.sort((line * np.uint64(bins) + bin_of) << value_bits | h & np.uint64((1 << 40) - 1))
    cell = key >> value_bits
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    low = np.full(len(lines) * bins, np.uint64(1 << 63), np.uint64)
    low[cell[first].astype(np.int64)] = key[first] & np.uint64((1 << 40) - 1)
    low = low.reshape(len(lines), bins)
    # an empty bin takes another's value, by probes that depend on its own number alone
    some = np.flatnonzero((low == np.uint64(1 << 63)).any(axis=1))
    part = low[some]
    full = part != np.uint64(1 << 63)
    for attempt in range(64):
        probe = (_mixed(np.arange(bins, dtype=np.uint64) * np.uint64(64) + np.uint64(attempt + 1)) % np.uint64(bins)).astype(np.int64)
        take = (part == np.uint64(1 << 63)) & full[:, probe]
        part = np.where(take, part[:, probe] ^ np.uint64(attempt + 1 << 41), part)
        left = np.flatnonzero((part == np.uint64(1 << 63)).any(axis=1))
        if len(left) < len(some):
            low[some], (some, part, full) = part, (some[left], part[left], full[left])
        if not len(some):
            break
    sums = np.zeros((len(lines), bands), np.uint64)
    for r in range(rows):
        sums = _mixed(sums * _MUL + low[:, r::rows])
    return _mixed(sums + np.arange(1, bands + 1, dtype=np.uint64) * _MUL)


def shingle_sets(lines: list[str], k: int) -> list[np.ndarray]:
    """Each line's distinct shingles, as sorted 64-bit hashes."""
    h, n = shingle_hashes(lines, k)
    out, at = [], 0
    for m in n.tolist():
        x = np.sort(h[at : at + m])
        out.append(x[np.append(True, x[1:] != x[:-1])])
        at += m
    return out


def jaccard_forest(sets: list[np.ndarray], similar: float):
    """Pairs (i, j) enough to join all sets that exact Jaccard similarity joins: pairs within a component found already aren't compared."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(sets) - 1):
        a = sets[i]
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if min(len(a), len(b)) < similar * max(len(a), len(b)) or root(i) == root(j):
                continue
            x = np.sort(np.concatenate([a, b]))
            both = int(np.count_nonzero(x[1:] == x[:-1]))
            if both >= similar * (len(x) - both):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
                yield i, j


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, copy, text): the texts that aren't null; copy tells texts of one id apart."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text")).where(text.isNotNull())


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR) -> DataFrame:
    """The lines to drop: (doc, copy, lines, all) with the numbers of a text's lines that repeat an earlier one, by (doc, line).

    copy: xxhash64 of the text, to tell texts under one id apart.  all: the numbers of
    all visible lines, where several rows have the id and the text (these go from all of the rows but one); else null.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    texts = _texts(docs, id_col, text_col)

    def sign(batches):
        for b in slices(batches, most=1 << 19):
            doc, copy, no, lines, lead = [], [], [], [], []
            for d, c, t in zip(b.column("doc").to_pylist(), b.column("copy").to_pylist(), b.column("text").to_pylist()):
                first = True
                for i, line in enumerate(t.split("\n")):
                    if line := normal_line(line):
                        doc.append(d)
                        copy.append(c)
                        no.append(i)
                        lines.append(line)
                        lead.append(first)
                        first = False
            if lines:
                h = np.fromiter((xxhash.xxh3_64_intdigest(l.encode("utf-8", "surrogatepass")) for l in lines), np.uint64, len(lines)).view(np.int64)
                _, once, own = np.unique(h, return_index=True, return_inverse=True)  # a line that a slice repeats is signed once
                keys = band_keys([lines[i] for i in once.tolist()], k, bands, rows).view(np.int64)[own]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(copy, pa.int64()), pa.array(no, pa.int32()), pa.array(lead, pa.bool_()), pa.array(h), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))], names=["doc", "copy", "no", "lead", "h", "keys"])

    signed = written(texts.mapInArrow(sign, "doc long, copy long, no int, lead boolean, h long, keys array<long>"), "signed")
    # equal lines once; the keys that several of them share
    distinct = signed.groupBy("h").agg(F.first("keys").alias("keys"))
    keyed = distinct.select("h", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    met = met.checkpoint()
    some = keyed.join(if_small(met, 48), "key").withColumn("tile", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int"))
    one = some.where("tiles = 1").select("key", "h", F.lit(0).alias("s"), F.lit(0).alias("t"))
    more = some.where("tiles > 1").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", "h", F.least("tile", "x").alias("s"), F.greatest("tile", "x").alias("t"))
    groups = one.unionByName(more).groupBy("key", "s", "t").agg(F.array_sort(F.collect_list("h")).alias("hs")).where(F.size("hs") > 1)
    groups = written(groups.select("hs").distinct().select(F.xxhash64("hs").alias("g"), "hs"), "groups")
    wanted = groups.select("g", F.explode("hs").alias("h"))
    needed = wanted.select("h").distinct().checkpoint()

    # the candidates' texts: each from the first place that has it, so that only those lines of those documents are looked at
    places = signed.select("h", "doc", "copy", "no").join(if_small(needed, 32), "h").groupBy("h").agg(F.min(F.struct("doc", "copy", "no")).alias("at"))
    places = places.groupBy(F.col("at.doc").alias("at_doc"), F.col("at.copy").alias("at_copy")).agg(F.collect_list(F.struct(F.col("at.no").alias("no"), "h")).alias("wanted"))
    places = written(places, "places")
    size = places.agg(F.sum(F.size("wanted") * 16 + 56)).first()[0] or 0
    side = F.broadcast(places) if size <= BROADCAST_BYTES else places
    held = texts.join(side, F.col("doc").eqNullSafe(F.col("at_doc")) & (F.col("copy") == F.col("at_copy")))

    def picked(lines):  # a function's parameter, so that the text is split once
        return F.transform("wanted", lambda w: F.struct(w.h.alias("h"), F.get(lines, w.no).alias("line")))

    found = F.get(F.transform(F.array(F.split("text", "\n", -1)), picked), F.lit(0))
    lines = held.select(F.explode(found).alias("x")).groupBy("x.h").agg(F.first("x.line").alias("line"))
    full = wanted.join(lines, "h").groupBy("g").agg(F.collect_list(F.struct("h", "line")).alias("members"))

    def verify(batches):
        for batch in batches:
            members = batch.column("members")
            at = (members.offsets.to_numpy() - members.offsets[0].as_py()).tolist()
            hs, lines = members.flatten().field("h").to_numpy(), [normal_line(l) for l in members.flatten().field("line").to_pylist()]
            i = 0
            while i < len(at) - 1:  # some groups at a time
                j = i + 1
                while j < len(at) - 1 and at[j + 1] - at[i] <= 1024:
                    j += 1
                sets, a, b = shingle_sets(lines[at[i] : at[j]], k), [], []
                for x, y in zip(at[i:j], at[i + 1 : j + 1]):
                    for p, q in jaccard_forest(sets[x - at[i] : y - at[i]], similar):
                        a.append(hs[x + p])
                        b.append(hs[x + q])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                i = j

    parts = connected_components(full.select("members").mapInArrow(verify, "a long, b long"))
    # the first place of each component's lines; what stands elsewhere goes
    place = F.struct("doc", "copy", "no")
    firsts = signed.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    named = firsts.join(parts, F.col("h") == F.col("node"), "left").select("h", "first", "n", F.coalesce("component", "h").alias("part"))
    kept = named.groupBy("part").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1")
    repeated = named.join(kept.drop("n"), "part").select("h", "keep").checkpoint()
    gone = signed.select("doc", "copy", "no", "h").join(if_small(repeated, 64), "h").where(~F.struct("doc", "copy", "no").eqNullSafe(F.col("keep")))
    gone = gone.groupBy("doc", "copy").agg(F.collect_set("no").alias("lines")).withColumn("all", F.lit(None).cast("array<int>"))
    # rows that share id and text: each text's first visible line is met once a row
    again = signed.where("lead").groupBy("doc", "copy").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("d"), F.col("copy").alias("c")).checkpoint()
    if not again.isEmpty():
        theirs = signed.join(if_small(again, 48), F.col("doc").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left_semi")
        theirs = theirs.groupBy("doc", "copy").agg(F.collect_set("no").alias("all"))
        gone = gone.unionByName(theirs, allowMissingColumns=True).groupBy("doc", "copy").agg(F.first("lines", True).alias("lines"), F.first("all", True).alias("all"))
    gone = written(gone, "gone")
    release(signed, groups, places)
    return gone


def drop_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "text", n_col: str | None = None) -> DataFrame:
    """``docs`` with the lines ``gone`` (see duplicate_lines) taken out of the text; all columns stay, in order.

    Of rows that share id and text all but one lose all visible lines.
    """
    length = lambda c: F.coalesce(F.size(c), F.lit(0)) * 4
    size, repeated = gone.agg(F.sum(length("lines") + length("all") + 56), F.count("all")).first()
    size = size or 0
    side = gone.select(F.col("doc").alias("gone_doc"), F.col("copy").alias("gone_copy"), F.col("lines").alias("gone_lines"), F.col("all").alias("gone_all"))
    side = F.broadcast(side) if size <= BROADCAST_BYTES else side
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    i, t = names.index(id_col), names.index(text_col)
    joined = inner.join(side, F.col(f"c{i}").cast("long").eqNullSafe(F.col("gone_doc")) & (F.xxhash64(f"c{t}") == F.col("gone_copy")), "left")
    if repeated:
        # the rows are numbered in a written table, so that a lost task can't choose another row
        same = written(joined.where("gone_all IS NOT NULL").withColumn("row_no", F.monotonically_increasing_id()), "same")
        stays = same.groupBy("gone_doc", "gone_copy").agg(F.min("row_no").alias("row_no")).select("row_no", F.lit(True).alias("stays"))
        same = same.join(stays, "row_no", "left").withColumn("gone_lines", F.when(F.col("stays"), F.col("gone_lines")).otherwise(F.col("gone_all")))
        joined = joined.where("gone_all IS NULL").unionByName(same.drop("row_no", "stays"))
    # by sets: a text of many lines of which many go takes no longer than reading it
    def left(lines):  # a function's parameter, so that the text is split once
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone_lines"), lambda n: F.get(lines, n)), "\n")

    text = F.when(F.col("gone_lines").isNull(), F.col(f"c{t}")).otherwise(F.get(F.transform(F.array(F.split(F.col(f"c{t}"), "\n", -1)), left), F.lit(0)))
    out = [F.col(f"c{j}").alias(c) if c != text_col or out_col != text_col else text.alias(c) for j, c in enumerate(names)]
    if out_col != text_col:
        out.append(text.alias(out_col))
    if n_col:
        out.append(F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias(n_col))
    return joined.select(*out)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_col: str | None = None, **options) -> DataFrame:
    """``docs`` with each near-duplicate line kept once: at its component's first place by (id, hash of the text, line number).

    Lines are compared in lower case with white space collapsed; lines without a
    visible character always stay.  Lines link at a Jaccard similarity of
    ``similar`` or more between their sets of ``k``-character shingles (a
    shorter line is one shingle).  Null and empty texts stay as they are; null
    ids sort first; of rows that repeat an id and a text one (any) keeps what the text keeps, the others
    lose all visible lines.  Other columns are passed through; ``n_col`` adds the number of lines removed.
    """
    return drop_lines(docs, duplicate_lines(docs, id_col, text_col, **options), id_col, text_col, n_col=n_col)
