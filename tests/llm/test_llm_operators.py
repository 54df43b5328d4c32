"""Every operator against a brute-force version, and over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skarn.llm import decontamination, langid, license_scan, line_dedup, packing, secret_scan, simhash, substring_dedup, token_counts, topk
from skarn.llm.components import connected_components
from skarn.llm.license_scan import scan_licenses

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, block string, component int"
WORDS = "the of and tion was shing erth blea onwh ndly hest Getz über garçon señal 日本 x1 don't".split()


def _text(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ", ", "\n", ". "]) for _ in range(n))


def _docs(spark, extra=(), seed=1, n=30):
    r = random.Random(seed)
    texts = [_text(r, r.randint(0, 80)) for _ in range(n)]
    texts += [texts[3], texts[4], texts[5] + " more", None, "", " \n\t ", "x", _text(r, 6000), "word " * 3000, *extra]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["a", "a", "b", None]), 0, 1, "b", 2) for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[3], "en", "a", 0, 1, "b", 2)]
    return spark.createDataFrame(rows, DOCS), rows


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(1, 1), (None, 3), (5, 6), (5, 6)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _packed(spark, df, **options):
    return packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), **options).collect()


def _sent(rows, targets, window, segment):
    """Deficit round-robin, one packet after another: rows are (row number, source, tokens) in the order of their queues."""
    total = sum(n for _, _, n in rows)
    queues = {}
    for number, source, n in rows:
        queues.setdefault(source, []).extend((number, a, min(segment, n - a)) for a in range(0, n, segment))
    lengths = {s: sum(p[2] for p in q) for s, q in queues.items()}
    free = sum(n for s, n in lengths.items() if s not in targets)
    quantum = {s: Fraction(targets[s]) * window if s in targets else (1 - sum(map(Fraction, targets.values()))) * window * Fraction(n, free) for s, n in lengths.items()}
    deficit, out, at = dict.fromkeys(queues, 0), {}, 0
    while any(queues.values()):
        for s in sorted(queues, key=lambda s: (s is not None, s)):
            deficit[s] += quantum[s]
            while queues[s] and queues[s][0][2] <= deficit[s]:
                number, start, n = queues[s].pop(0)
                deficit[s] -= n
                out[number, start] = at
                at += n
    assert at == total
    return out


@pytest.mark.parametrize(("targets", "segment", "partitions"), [({}, 16, 3), ({"a": 0.5, "b": 0.25}, 16, 1), ({}, 1024, 4)])
def test_packing_places_are_those_of_a_sequential_round_robin(spark, targets, segment, partitions):
    r = random.Random(3)
    rows = [(i, _text(r, r.randint(0, 60)), None, r.choice(["a", "a", "b", "c", None]), 0, 0, "", 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).repartitionByRange(partitions, "doc_id")
    order = [x.doc_id for x in df.collect()]  # blocks one after another
    out = _packed(spark, df, window=64, segment=segment, targets=targets or None)
    tokens = {p.doc_id: p.doc_tokens for p in out}
    want = _sent([(i, rows[i][3], tokens[i]) for i in order], targets, 64, segment)
    got = {(p.doc_id, p.start): p.sequence_id * 64 + p.offset for p in out}
    for (i, start), at in want.items():  # each packet's first token lies in the piece that holds it
        piece = max(a for d, a in got if d == i and a <= start)
        assert got[i, piece] + start - piece == at


def test_packing_round_trip(spark, docs, empty):
    df, rows = docs
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(tuple(t.encode(x[1] or "", add_special_tokens=False).ids + [1]) for x in rows)
    out = _packed(spark, df, window=64, segment=32)
    places = sorted((p.sequence_id * 64 + p.offset, p.length) for p in out)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0
    assert all(p.offset + p.length <= 64 for p in out)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in out)
    by = {}
    for p in out:
        by.setdefault(p.doc_id, []).append(p)
    got = []
    for doc, ps in by.items():
        ps.sort(key=lambda p: p.start)
        if sum(p.length for p in ps) == ps[0].doc_tokens:  # ids of single rows; repeated ones interleave
            got.append(tuple(np.frombuffer(b"".join(p.ids for p in ps), "<u4").tolist()))
    single = [x for x in by if x != 2]
    assert len(got) == len(single) and set(got) <= set(want)
    assert sum(p.length for p in out) == sum(map(len, want))
    assert _packed(spark, empty) == []


def test_packing_mixture(spark):
    rows = [(i, "of " * 50, "en", "ab"[i % 2], 0, 0, "", 0) for i in range(80)]
    out = _packed(spark, spark.createDataFrame(rows, DOCS), window=128, segment=8, targets={"a": 0.75})
    share = {}
    for p in out:
        share.setdefault(p.sequence_id, {}).setdefault(p.source, 0)
        share[p.sequence_id][p.source] += p.length
    for w in range(10):  # until source a runs out: off by a packet at each end
        assert abs(share[w]["a"] - 96) <= 16 and abs(share[w]["b"] - 32) <= 16


def test_packing_of_many_sources(spark):
    """Each of 400 sources has its own queue, and a target holds for the smallest too."""
    rows = [(i, "of " * (i % 7 + 1), None, f"s{i % 400}", 0, 0, "", 0) for i in range(1200)] + [(5000 + i, "of " * 3, None, "tiny", 0, 0, "", 0) for i in range(8)]
    out = _packed(spark, spark.createDataFrame(rows, DOCS), window=32, targets={"tiny": 0.5})
    assert sum(p.length for p in out) == sum(i % 7 + 2 for i in range(1200)) + 8 * 4
    places = sorted((p.sequence_id * 32 + p.offset, p.length) for p in out)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    assert {p.sequence_id for p in out if p.source == "tiny"} <= {0, 1, 2}
    assert len(out) < 2 * len(rows)


def test_token_counts(spark, docs, empty):
    odd = ["a  b\n\n c", "a\xa0 \xa0b", "<|endoftext|> x<|endoftext|>", "\x1c\x1d a", "tab\t\tb ", "  lead", "trail  ", "don't we'll 12ab_cd", "日本語　テキスト", "é" * 500]
    df, rows = _docs(spark, odd, seed=4)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((x[0] is None, x[0] or 0, len((x[1] or "").encode()), n, n > 50) for x in rows for n in [len(t.encode(x[1] or "", add_special_tokens=False).ids)])
    run = lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json"), 50).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in run(df)) == want
    assert run(empty) == []


def test_token_counts_over_blocks_and_wings(spark, docs, monkeypatch):
    """A word that all documents hold is counted the same wherever blocks and wings end."""
    df, rows = docs
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, path).collect())
    monkeypatch.setattr(token_counts, "WING", 1)
    monkeypatch.setattr(token_counts, "BUCKETS", 3)
    monkeypatch.setattr(token_counts, "BLOCK_PAIRS", 50)
    got = token_counts.count_tokens(df.repartition(4), path).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want


def _fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    df, rows = docs
    fps = [_fingerprint(x[1]) for x in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    ids = {}
    for i, x in enumerate(rows):
        if x[0] is not None:
            ids[root(i)] = min(ids.get(root(i), 1 << 60), x[0])
    want = sorted((str(x[0]), f"{f:016x}", ids.get(root(i))) for i, (x, f) in enumerate(zip(rows, fps)))
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_keep_every_connection(spark, monkeypatch):
    """Clusters of fingerprints around centres, beyond a tile."""
    monkeypatch.setattr(simhash, "TILE", 16)
    r = random.Random(3)
    fps = set()
    for _ in range(4):
        c = r.getrandbits(64)
        for _ in range(80):
            x = c
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = [(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    found = {x: x for x in fps}

    def top(x):
        while found[x] != x:
            x = found[x]
        return x

    for a, b in links:
        p, q = top(a), top(b)
        found[max(p, q)] = min(p, q)
    assert {x: top(x) for x in fps} == {x: root(x) for x in fps}


def _best(v, queries, k=10):
    out = []
    for q in queries:
        s = sorted((-sum(a * b for a, b in zip(v[q], v[j])), j) for j in range(len(v)) if j != q)[:k]
        out += [(q, n + 1, j, -m) for n, (m, j) in enumerate(s)]
    return out


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 8))
    v[10:40] = v[5]  # ties
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(400, None, 1), (500, [1.0, None] + [0.0] * 6, 1), (600, [float("nan")] + [0.0] * 7, 1), (None, v[0].tolist(), 1), (700, [1.0, 2.0], 1), (800, [float("inf")] + [0.0] * 7, 1), (900, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    want = _best(np.floor(1024 * v).astype(int).tolist(), (0, 100, 200))
    for at_once, sample in ((1 << 15, 1024), (2, 16)):
        monkeypatch.setattr(topk, "QUERIES_AT_ONCE", at_once)
        monkeypatch.setattr(topk, "SAMPLE", sample)
        got = topk.top_k(df, lambda i: i % 100 == 0, k=10).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == want  # the vector of another length has no candidates
    assert topk.top_k(df.where("vec_id < 0"), lambda i: i % 100 == 0).count() == 0


def test_top_k_of_repeated_rows_and_queries(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 9.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0, scale=1, k=3).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 2, 0)]


@pytest.mark.parametrize("size", [1e6, 1e12, 1e16, 1e200])
def test_top_k_of_large_components(spark, size):
    r = np.random.default_rng(2)
    v = r.normal(size=(80, 4)) * size
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, lambda i: i % 40 == 0, k=5).orderBy("query_id", "rank").collect()
    exact = [[int(np.floor(1024 * x)) for x in row] for row in v.tolist()]
    clip = lambda s, most: max(-most, min(most, s))
    want = []
    for q in (0, 40):
        s = sorted((-clip(sum(a * b for a, b in zip(exact[q], exact[j])), 10**38 - 1), j) for j in range(80) if j != q)[:5]
        want += [(q, n + 1, j, clip(-m, (1 << 63) - 1)) for n, (m, j) in enumerate(s)]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == want


def test_top_k_eliminates(spark):
    """Around centres of unlike directions, most rows are never scored."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 16)) * 10
    v = centres[np.arange(4000) % 20] + r.normal(size=(4000, 16)) * 0.05
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, lambda i: i % 100 == 0, stats=True).select("query_id", "n_scored").distinct().collect()
    assert len(got) == 40 and sum(x.n_scored for x in got) < 0.5 * 40 * 4000


def test_secrets(spark, empty):
    hexes = hashlib.sha1(b"x").hexdigest()
    texts = ['token=token=abcdefgh', 'token=token:abcdefg', f'password = "{hexes}"', "AKIAAKIA", "AKIA" + "Z9" * 9, "api_key: ab", "PassWd:='a=b=c=d'", "ñ secret: ñabcdef secret:abcdefg", "deadbeef" * 4, None, "", "bearer " + "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the authorization Zk9xQ2vL8mN3pR7tW1yB5dF0 was", "token of_the_configuration_document_source"]
    df, rows = _docs(spark, texts)
    a = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secret_scan.scan_secrets(df).collect():
        t = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        spans = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        novel = [s for s in r.spans.split(",") if s.startswith("novel")]
        if "Zk9x" in t or (hexes in t):
            assert len(novel) == 1
        if "of_the_configuration" in t or t.startswith("bearer"):
            assert not novel
    assert secret_scan.scan_secrets(empty).count() == 0


def test_secrets_in_names_and_of_small_alphabets(spark):
    r = random.Random(4)
    key = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=30))
    names = "AWS_SECRET_ACCESS_KEY SECRET_KEY client_secret db-password GITHUB_TOKEN accessToken clientSecret AWSSecretKey token".split()
    others = "tokenizer author secretary SUBTOKENS".split()
    upper = ["".join(r.choices(a, k=n)) for a in ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789") for n in (88, 128, 256, 1000) for _ in range(10)]
    texts = [f'{w} = "{key}"' for w in names + others] + [f'secret "{v}"' for v in upper]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in secret_scan.scan_secrets(df).collect()}
    for i, w in enumerate(names):
        assert f"novel:{len(w) + 4}:{len(w) + 34}" in got[i].spans, w
    assert not any(got[len(names) + i].n_novel for i in range(len(others)))
    assert sum(got[len(names) + len(others) + i].n_novel == 1 for i in range(len(upper))) >= 0.95 * len(upper)


def test_secrets_recall_and_precision(spark):
    """Random keys of many kinds beside sensitive words, and identifiers of words that the texts use."""
    r = random.Random(14)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = [lower + lower.upper() + digits, lower + digits, lower.upper() + digits, digits + "abcdef", lower + lower.upper() + digits + "+/"]
    words = "http request retry interceptor customer billing address validator quick brown jumps over session manager payment gateway".split()
    frames = ['client_secret = "{}"', "the api key is {} for now", "Authorization: Bearer {}", "const auth_token = '{}';", '"{}" is the password', "{} # private key"]
    rows = []
    for _ in range(300):
        rows.append((r.choice(frames).format("".join(r.choices(r.choice(kinds), k=r.choice([20, 24, 32, 40, 64, 128])))), True))
    for _ in range(300):
        ws = r.sample(words, r.randint(3, 5))
        rows.append((r.choice(frames).format(r.choice(["-".join(ws), "_".join(ws), "".join(w.title() for w in ws), "".join(ws)])), False))
    rows += [(f"def {r.choice(words)}_{r.choice(words)}(token): return {r.choice(words)}.{r.choice(words)}", None) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x.n_novel for x in secret_scan.scan_secrets(df).collect()}
    keys, names = [got[i] for i, x in enumerate(rows) if x[1]], [got[i] for i, x in enumerate(rows) if x[1] is False]
    assert sum(map(bool, keys)) >= 0.95 * len(keys)
    assert sum(map(bool, names)) <= 0.05 * len(names)


def test_secrets_of_long_texts_and_repeated_rows(spark):
    began = time.time()
    secret_scan.novel_spans("token/" * 20_000, secret_scan.Novelty())
    secret_scan.novel_spans("token " * 20_000, secret_scan.Novelty())
    assert time.time() - began < 20
    df = spark.createDataFrame([(1, "password: Zk9xQ2vL8mN3pR7tW1yB5dF0"), (1, "password: Zk9xQ2vL8mN3pR7tW1yB5dF0"), (None, None)], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_assign, x.n_novel) for x in secret_scan.scan_secrets(df).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("None", 0, 0)]


def test_licenses(spark, empty):
    texts = ["Released under the MIT License. under the mit-license", "Apache License, Version 2", "cc by-nc cc/by/nc", "under the mit", "mit license under the", "This is Licensed under the GNU General Public License, version 3!", "all rights RESERVED", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and related documentation files", None]
    df, rows = _docs(spark, texts)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    named = {}
    for r in scan_licenses(df).collect():
        t = next(x[1] for x in rows if x[0] == r.doc_id)
        w = word.findall((t or "").translate(fold))
        at = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in phrases}
        every = [i for s in at.values() for i in s]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(every), min(every, default=None), max(every, default=None))
        assert r.base_labels == ",".join(sorted({phrases[p] for p, s in at.items() if s}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        named[t] = r.labels
    assert [named[t] for t in texts[:8]] == ["mit", "apache-2", "cc-by-nc", "", "", "gpl-3", "reserved", "mit"]
    plan = scan_licenses(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert scan_licenses(empty).count() == 0


def test_licenses_of_the_gpl_family(spark):
    header = "This {0} is free software{1} you can redistribute it and/or modify\n * it under the terms of the {2} as published by\n * the Free Software Foundation{3} either version {4} of the License, or\n * (at your option) any later version.\n"
    gpl, lesser = "GNU General Public License", "GNU Lesser General Public License"
    cases = {
        header.format("program", ":", gpl, ",", "3"): "gpl-3",
        header.format("program", ";", gpl, ";", "2"): "gpl-2",
        header.format("library", ";", lesser, ";", "2.1"): "lgpl-2.1",
        header.format("library", ";", "GNU Library General Public License", ";", "2"): "lgpl-2",
        header.format("program", ":", lesser, ",", "3"): "lgpl-3",
        header.format("program", ":", "GNU Affero General Public License", ",", "3"): "agpl-3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.": "gpl-1",
        "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl-2",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.": "gpl-2",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution": "epl-1",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "epl-2",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "The General Public License of the Free Software Foundation is a long text.": "",
    }
    df = spark.createDataFrame([(i, f"int x; /* {t} */ int main") for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in scan_licenses(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_licenses_whole_texts_shares_and_repeated_rows(spark):
    mit = license_scan.NOTICES["mit"][-1]
    words = mit.split()
    lacking = [("zz" if i % 10 == 0 and i > 12 else w) for i, w in enumerate(words)]  # a tenth of the words are others
    half = " ".join(words[8 : len(words) // 2])
    texts = ["x y " + mit, " ".join(lacking), half, license_scan.NOTICES["zlib"][0].title(), " ".join(reversed(words)), "license " * 3000, " ".join(words[: len(words) - 4])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0]), (None, None), (0, "another text under the mit license")]
    got = sorted(scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert len(got) == len(rows) and sum(r.doc_id == 0 and r.labels == "mit" for r in got) == 3 and sum(r.doc_id is None for r in got) == 2
    by = {r.doc_id: r for r in got if r.doc_id}
    assert (by[1].labels, by[2].labels, by[3].labels, by[4].labels, by[5].labels, by[6].labels) == ("mit", "", "zlib", "", "", "mit")
    one = next(r for r in got if r.doc_id == 0 and r.n_words > 20)
    assert one.score == 1.0 and by[3].score == 1.0 and 0.8 <= by[1].score <= 1 and 0.9 < by[6].score <= 1 and by[2].score < 0.8


def test_language_id(spark, empty):
    r = random.Random(5)
    kinds = {"en": "the and of to that which ing tion was her".split(), "de": "der die und nicht ein sch keit ung über für".split(), "fr": "le la et une été pour que est où garçon".split()}
    rows = [(i, " ".join(r.choice(kinds[k]) for _ in range(40)), k, "s", 0, 0, "", 0) for i, k in enumerate(list(kinds) * 30)]
    train, test = spark.createDataFrame(rows[:60], DOCS), spark.createDataFrame(rows[60:] + [(900, None, "en", "", 0, 0, "", 0), (901, " 12 !", "en", "", 0, 0, "", 0), (902, "", None, "", 0, 0, "", 0)], DOCS)
    prototypes = langid.learn(train)
    got = {x.doc_id: x for x in langid.identify(test, prototypes).collect()}
    assert all(got[x[0]].lang_pred == x[2] and 0 < got[x[0]].score <= 1 for x in rows[60:])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert langid.learn(empty) == {} and langid.identify(empty, prototypes).count() == 0
    assert {x.lang_pred for x in langid.identify(test, {}).collect()} == {"und"}


def test_language_id_of_more_languages_than_fit(spark, monkeypatch):
    df = spark.createDataFrame([("abc def", f"l{i}") for i in range(8)], "text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGS", 8)
    found = langid.learn(df, dim=16)
    assert len(found) == 8 and all(np.allclose(v, found["l0"]) and v.any() for v in found.values())
    monkeypatch.setattr(langid, "MAX_LANGS", 7)
    with pytest.raises(ValueError, match="languages"):
        langid.learn(df, dim=16)


def test_language_id_against_plain_cosines_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = zlib.crc32
    rows = [r for r in docs.collect()]
    train = [r for r in rows if held(str(r.doc_id).encode()) % 3 != 1]
    prototypes = langid.learn(spark.createDataFrame(train, docs.schema))
    got = {r.doc_id: r for r in langid.identify(docs, prototypes).collect()}
    space = langid.Space()
    names = sorted(prototypes)
    right = tried = 0
    for r in rows:
        v, letters = space.bundle([r.text])
        cosines = [float(v[0] @ prototypes[n] / max(1e-9, np.linalg.norm(v[0]) * np.linalg.norm(prototypes[n]))) for n in names]
        if letters[0]:
            assert abs(got[r.doc_id].score - max(0, min(1, max(cosines)))) < 1e-4
            assert cosines[names.index(got[r.doc_id].lang_pred)] > max(cosines) - 1e-4
            if r.lang is not None and held(str(r.doc_id).encode()) % 3 == 1:
                tried, right = tried + 1, right + (got[r.doc_id].lang_pred == r.lang)
        else:
            assert got[r.doc_id].lang_pred == "und"
    assert tried > 100 and right >= 0.98 * tried


def test_language_vectors_are_the_plain_ones():
    space = langid.Space(64)
    text = "Größe, der"
    vectors, letters = space.bundle([text, "12"])
    one = np.zeros(64)
    for w in ("größe", "der"):
        p = " " + w + " "
        v = lambda c: space.letter(ord(c) if c != " " else 0).astype(int)
        for a, b, c in zip(p, p[1:], p[2:]):
            one += np.roll(v(a), 2) * np.roll(v(b), 1) * v(c)
    assert np.allclose(vectors[0], one) and letters.tolist() == [True, False]


def test_tiles():
    assert sorted(decontamination.tiles([1, 2, 3, 4, 5, 6, 7, 8], [5, 6, 7, 8, -1, 1, 2, 3, 4], 3)) == [(0, 5, 4), (4, 0, 4)]
    assert decontamination.tiles([1, 2, 3, 1, 2, 3], [1, 2, 3], 3) == [(0, 0, 3)]
    assert decontamination.tiles([1, 2, 3, 4], [1, 2, 9, 3, 4], 3) == []
    r = random.Random(6)
    for _ in range(200):
        a, b = [r.randrange(3) for _ in range(12)], [r.randrange(3) for _ in range(20)]
        got, free_a, free_b = decontamination.tiles(a, b, 2), [True] * 12, [True] * 20
        for i, d, n in got:  # each tile is as long as any that is left
            assert a[i : i + n] == b[d : d + n] and all(free_a[i : i + n]) and all(free_b[d : d + n])
            longest = max(m for x in range(12) for y in range(20) for m in range(0, 13) if x + m <= 12 and y + m <= 20 and a[x : x + m] == b[y : y + m] and all(free_a[x : x + m]) and all(free_b[y : y + m]))
            assert n == longest
            free_a[i : i + n], free_b[d : d + n] = [False] * n, [False] * n


def test_decontamination(spark, empty, monkeypatch):
    r = random.Random(7)
    item = [f"w{r.randrange(500)}" for _ in range(40)]
    items = spark.createDataFrame([(1, " ".join(item), 0), (2, None, 0), (3, "", 0), (4, "too short", 0), (5, " ".join(f"z{i}" for i in range(30)), 0)], "item_id long, text string, leaks int")
    swapped = item[25:] + ["gap"] + item[:25]
    part = item[:12]
    texts = ["before " + " ".join(item).upper() + ", after", " ".join(swapped), " ".join(part), "zz " * 30 + " ".join(item[:30]) + " yy" * 40, "clean " * 50]
    df, rows = _docs(spark, texts)
    df = df.withColumn("leaks", F.lit(1))
    for shard in (8 << 20, 100):
        monkeypatch.setattr(decontamination, "SHARD_BYTES", shard)
        got = {(x.doc_id, x.item_id): (round(x.coverage, 6), x.n_tiles) for x in decontamination.leaked_items(df, items).collect()}
        at = {t: next(x[0] for x in rows if x[1] == t) for t in texts}
        assert got == {(at[texts[0]], 1): (1.0, 1), (at[texts[1]], 1): (1.0, 2), (at[texts[3]], 1): (0.75, 1)}
    kept = decontamination.decontaminate(df, items)
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert decontamination.leaked_items(empty, items).count() == 0 and decontamination.leaked_items(df, items.where("item_id > 9")).count() == 0


def test_decontamination_against_brute_force(spark, monkeypatch):
    """Documents pieced together from the items: which leak, by tiling every document and item in the plainest way."""
    r = random.Random(21)
    items = [[f"w{r.randrange(30)}" for _ in range(r.randint(6, 30))] for _ in range(12)]
    docs = []
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 5)):
            t = r.choice(items)
            i = r.randrange(len(t))
            words += t[i : i + r.randint(3, 20)] + [f"q{r.randrange(30)}" for _ in range(r.randint(0, 3))]
        docs.append(words)

    def coverage(item, doc, k=5):
        free_i, free_d, total = [True] * len(item), [True] * len(doc), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(item)):
                for d in range(len(doc)):
                    n = 0
                    while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, d)
            n, i, d = best
            if n < k:
                return total / len(item)
            free_i[i : i + n], free_d[d : d + n] = [False] * n, [False] * n
            total += n

    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if coverage(item, doc) >= 0.5}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)] + [(1000, None), (0, " ".join(docs[0]))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for shard in (8 << 20, 120):
        monkeypatch.setattr(decontamination, "SHARD_BYTES", shard)
        got = [(x.doc_id, x.item_id) for x in decontamination.leaked_items(df, bench).collect()]
        # among tiles of equal length the choice can shift what is left: at the threshold itself the two may differ
        close = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if abs(coverage(item, doc) - 0.5) < 0.2}
        assert set(got) ^ want <= close and len(want) > 20 and len(set(got) ^ want) <= 2
        assert sum(d == 0 for d, _ in got) == 2 * len({i for d, i in got if d == 0})


def test_decontamination_of_one_word_without_end(spark):
    began = time.time()
    index = decontamination.Index([(1, [b"la"] * 60), (2, [b"x"] * 4 + [b"la"] * 8)], 5)
    assert [x[0] for x in index.leaks([b"la"] * 100_000, 0.5)] == [1, 2]
    assert time.time() - began < 20


def _line_brute(rows):
    """Which lines go: union-find over exact Jaccard of all lines."""
    k, lines = line_dedup.SHINGLE, []
    for x in rows:
        for i, l in enumerate((x[1] or "").split("\n")):
            if n := line_dedup.normal_line(l):
                lines.append(((x[0] if x[0] is not None else -1, i), n))
    texts = sorted({n for _, n in lines})
    sets = [frozenset(t[i : i + k] for i in range(max(1, len(t) - k + 1))) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= line_dedup.SIMILAR * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    number, first = {t: i for i, t in enumerate(texts)}, {}
    for place, n in lines:
        r = root(number[n])
        first[r] = min(first.get(r, place), place)
    return {place for place, n in lines if first[root(number[n])] != place}


def test_line_dedup(spark, empty, monkeypatch):
    r = random.Random(8)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(14)) for _ in range(25)]
    near = [b[:40] + "q" + b[41:] for b in base]
    extra = ["\n".join(r.sample(base + near, 5)) + "\n\n  \n" for _ in range(20)] + ["\n" + base[0].upper() + "  ", "a\nb\na", "é\nÉ"]
    df, rows = _docs(spark, extra, seed=9)
    gone = _line_brute(rows)
    for tile in (256, 4):
        monkeypatch.setattr(line_dedup, "TILE", tile)
        got = {}
        for x in line_dedup.dedup_lines(df.withColumn("copy", F.lit(1)), n_col="removed").collect():
            got.setdefault(x.doc_id, []).append((x.text, x.removed))
        for x in rows:
            key = x[0] if x[0] is not None else -1
            left = None if x[1] is None else "\n".join(l for i, l in enumerate(x[1].split("\n")) if (key, i) not in gone)
            assert (left, sum((key, i) in gone for i in range(len((x[1] or "").split("\n"))))) in got[x[0]]
    out = line_dedup.dedup_lines(empty)
    assert out.columns == empty.columns and out.count() == 0


def test_line_dedup_keeps_one_of_two_texts_under_an_id(spark):
    rows = [(5, "the same first line\nand one of its own"), (5, "the same first line\nand quite another here"), (6, "THE SAME  first line")]
    got = sorted(x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum("the same first line" in t for t in got) == 1 and "" in got and len(got) == 3


def test_line_dedup_of_repeated_rows(spark):
    """Of rows that share id and text one keeps its lines; blank lines stay in all, other columns and rows too."""
    rows = [(7, "a line of one text\n\nits other line", i) for i in range(5)] + [(None, "no id at all here", 9)] * 3 + [(8, None, 1)] * 2 + [(9, "", 1)] * 2 + [(9, " \n ", 1)] * 2 + [(3, "its other line", 4)]
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string, row_no int").repartition(parts)
        got = [tuple(x) for x in line_dedup.dedup_lines(df, n_col="gone").collect()]
        assert sorted(x[2] for x in got) == sorted(x[2] for x in rows)
        assert sorted((x[1], x[3]) for x in got if x[0] == 7) == sorted([("", 2)] * 4 + [("a line of one text\n", 1)])
        assert sorted((x[1], x[3]) for x in got if x[0] is None) == [("", 1)] * 2 + [("no id at all here", 0)]
        assert [x[1] for x in got if x[0] == 8] == [None] * 2 and sorted(x[1] for x in got if x[0] == 9) == ["", "", " \n ", " \n "]
        assert [(x[1], x[3]) for x in got if x[0] == 3] == [("its other line", 0)]


def test_line_dedup_of_a_text_of_very_many_repeated_lines(spark):
    text = "\n".join(["the line of a log that says the same"] * 200_000 + ["the end"])
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), n_col="gone").first()
    assert got.text == "the line of a log that says the same\nthe end" and got.gone == 199_999


def test_band_recall():
    """Pairs at a similarity of about 0.8 meet in a band."""
    r = random.Random(10)
    met = tried = 0
    for _ in range(300):
        a = "".join(r.choice("abcdefghij ") for _ in range(200))
        at = r.randrange(20, 160)
        b = a[:at] + "".join(r.choice("xyz") for _ in range(13)) + a[at + 13 :]
        x, y = ({t[i : i + 8] for i in range(193)} for t in (a, b))
        if len(x & y) / len(x | y) >= 0.8:
            tried += 1
            k = line_dedup.band_keys([a, b])
            met += bool((k[0] == k[1]).any())
    assert tried > 200 and met / tried > 0.98


def _substrings_brute(rows, window=13):
    first = {}
    split = [[w for w in re.split(rb"[\x20\x09-\x0d]+", (x[1] or "").encode()) if w] for x in rows]
    for x, w in zip(rows, split):
        for i in range(len(w) - window + 1):
            if x[0] is not None:
                key = b" ".join(w[i : i + window])
                first[key] = min(first.get(key, x[0]), x[0])
    out = []
    for x, w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if x[0] is not None and first[b" ".join(w[i : i + window])] < x[0]:
                gone.update(range(i, i + window))
        kept = b" ".join(v for i, v in enumerate(w) if i not in gone)
        out.append((str(x[0]), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, empty, monkeypatch):
    r = random.Random(11)
    passages = [" ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(n)) for n in (12, 13, 14, 20, 60)]
    extra = [" ".join(r.choice([_text(r, 9), r.choice(passages)]) for _ in range(6)) for _ in range(40)]
    extra += ["a " * 40, "a " * 13, "a " * 12, "a " * 14 + "b", " ".join(passages[4].split()[:30]), passages[4].replace(" ", "\n")]
    df, rows = _docs(spark, extra, seed=12)
    df = df.repartition(5)
    for hot in (256, 2):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        got = substring_dedup.dedup_substrings(df.withColumn("copy", F.lit(1))).collect()
        assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in got) == _substrings_brute(rows)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_automaton():
    r = random.Random(13)
    for _ in range(100):
        texts = [[r.randrange(3) for _ in range(r.randrange(1, 15))] for _ in range(4)]
        m = substring_dedup.Automaton()
        for t in texts:
            m.add(t)
        probe = [r.randrange(3) for _ in range(25)]
        inside = lambda s: any(t[i : i + len(s)] == s for t in texts for i in range(len(t)))  # noqa: E731, B023
        want = [max(n for n in range(i + 2) if n == 0 or inside(probe[i + 1 - n : i + 1])) for i in range(25)]
        assert m.matching(probe) == want
