"""The pipeline's stages, each on what the one before kept."""

import base64
import random

import corpus_pipeline as p
from skarn.llm import line_dedup
from skarn.llm.simhash import fingerprint


def test_stages_over_the_small_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for i, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs)
        if i < 4:
            assert docs.columns == p.COLUMNS
    raw, language, lines, near, clean, packed = [{r.doc_id: r for r in d.collect()} if i < 5 else d.collect() for i, d in enumerate(seen)]
    assert set(packed_ids := {r.doc_id for r in packed}) == set(clean) and packed_ids
    assert set(clean) <= set(near) <= set(lines) <= set(language) <= set(raw)
    assert all(language[i].text == raw[i].text for i in language)
    # a document goes for its language only if it holds nothing of one that is known
    assert all(sum(c.isalpha() for c in (raw[i].text or "")) < 200 for i in set(raw) - set(language))
    # no line is left twice
    kept = [line_dedup.normal_line(l) for r in lines.values() for l in r.text.split("\n")]
    kept = [l for l in kept if l]
    assert len(kept) == len(set(kept))
    # one document of each near-duplicate group, the first
    fps = {i: fingerprint(r.text) for i, r in lines.items()}
    for i in set(lines) - set(near):
        assert any((fps[i] ^ fps[j]).bit_count() <= 3 for j in lines if j != i)
    left = [fps[i] for i in near]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(left) for b in left[:k])
    # benchmark passages word for word are gone
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(t in r.text for r in clean.values() for t in items)
    # windows are full but for the last
    ends = {}
    for r in packed:
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 for k, n in ends.items() if k != max(ends))


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_language_stage_rejects_foreign_and_random_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(p.COLUMNS)
    r = random.Random(1)
    foreign = [" ".join("".join(chr(r.randint(a, b)) for _ in range(r.randint(2, 9))) for _ in range(n)) for a, b in ((0x430, 0x44F), (0x4E00, 0x9FA5), (0x3B1, 0x3C9), (0x627, 0x64A)) for n in (3, 10, 50, 200) for _ in range(10)]
    junk = [base64.b64encode(r.randbytes(n)).decode() for n in (30, 100, 300, 1000, 5000) for _ in range(20)]
    # the beginnings of the table's own texts, in all its languages
    clean = [" ".join(x.text.split()[:8]) for x in docs.where("n_chars > 300").orderBy("doc_id").collect()]
    texts = foreign + junk + clean
    rows = [(10**9 + i, t, None, "x", len(t)) for i, t in enumerate(texts)]
    kept = {x.doc_id - 10**9 for x in p.language_id(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), sf).where("doc_id >= 1000000000").collect()}
    n, m = len(foreign), len(foreign) + len(junk)
    assert not any(i in kept for i in range(n))
    assert sum(i in kept for i in range(n, m)) <= 0.05 * len(junk)
    assert sum(i in kept for i in range(m, len(texts))) >= 0.98 * len(clean) and len(clean) > 50


def test_simhash_stage_keeps_one_row_of_each_group(spark, sf):
    texts = ["".join(f"{w}{i} " for i in range(40)) for w in ("a", "b", "c", "d", "e", "f")]
    ids = [
        *[(None, texts[0])],  # unique, without an id
        *[(None, texts[1]), (None, texts[1])],  # a group without ids
        *[(7, texts[2]), (7, texts[3])],  # two texts under one id
        *[(5, texts[4]), (9, texts[4]), (None, texts[4])],  # the smallest id stays
        *[(5, texts[5]), (2, texts[5])],  # 5 stays elsewhere, but not here
    ]
    docs = spark.createDataFrame([(i, t, "en", str(k), len(t)) for k, (i, t) in enumerate(ids)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or -1, r.text) for r in p.simhash_dedup(spark, docs, sf).collect()))
    assert got == sorted([(-1, texts[0]), (-1, texts[1]), (7, texts[2]), (7, texts[3]), (5, texts[4]), (2, texts[5])])
