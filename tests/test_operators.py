"""Operators on small fixtures, among them rows without known features and empty ones."""

import math
import random
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.functions import scalars as sc
from skarn.functions import vectors as vx
from skarn.operators import baselines, features, infotheory, metrics, models, neighbours, rows, sampling, text, transforms
from skarn.sources import readers, synthetic, writers
from skarn.streaming import online


def test_calendar(spark):
    days = [date(2015, 12, 25) + timedelta(i) for i in range(500)]
    out = spark.createDataFrame([(d,) for d in days], "d date").select("d", *sc.date_features(F.col("d"))).collect()
    for r in out:
        iso = r.d.isocalendar()
        assert (r.day_of_week, r.week_of_year, r.day_of_year) == (iso[2], iso[1], r.d.timetuple().tm_yday)
        quarter = date(r.d.year, (r.d.month - 1) // 3 * 3 + 1, 1)
        assert (r.calendar_quarter, r.day_of_quarter) == ((r.d.month + 2) // 3, (r.d - quarter).days + 1)


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        sc.java_hash(F.lit("hello")).alias("h"), sc.java_hash(F.lit("lo"), "hel").alias("s"), sc.mod_hash(F.lit("polygenelubricants"), 7).alias("m"),
        sc.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("x"), sc.sigmoid(F.lit(0.0)).alias("g"), sc.parse_multilabel(F.lit("b, a=true,c=false,a")).alias("l"),
        sc.parse_regressor(F.lit("x=1.5,2")).alias("r"), sc.duration(F.lit(90061001)).alias("d"), sc.json_to_map(F.lit('{"a": 1, "b": "x", "c": {"d": 1}}')).alias("j"),
        sc.ratio(F.lit(1), F.lit(0)).alias("z"), sc.feature_name("f", F.lit("v")).alias("n"), sc.shift_normalise(F.array(F.lit(1.0), F.lit(2.0))).alias("q"),
    ).first()
    assert row.h == row.s == 99162322 and row.m == -(2**31 % 7) and row.x == [0.5, 0.5] and row.g == 0.5
    assert row.l == ["a", "b"] and row.r == {"x": 1.5, "DIM-1": 2.0} and row.d == "1 days, (01:01:01:001)" and row.j == {"a": "1", "b": "x"}
    assert row.z == 0.0 and row.n == "f@v" and abs(sum(row.q) - 1) < 1e-12


def test_vectors(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=5), r.normal(size=5)
    x, y = (F.array(*[F.lit(float(v)) for v in s]) for s in (a, b))
    got = spark.range(1).select(vx.dot(x, y), vx.l1(x, y), vx.l2(x, y), vx.cosine_similarity(x, y), vx.variance(x), vx.arg_max(x), vx.arg_min(x), vx.rbf_kernel(x, y, 0.3), vx.sparse_dot(F.create_map(F.lit("a"), F.lit(2.0)), F.create_map(F.lit("a"), F.lit(3.0), F.lit("b"), F.lit(1.0)))).first()
    want = [a @ b, abs(a - b).sum(), np.linalg.norm(a - b), a @ b / np.linalg.norm(a) / np.linalg.norm(b), a.var(ddof=1), a.argmax(), a.argmin(), math.exp(-0.3 * ((a - b) ** 2).sum()), 6]
    assert np.allclose(got, want)
    zero = spark.range(1).select(vx.cosine_distance(x, F.array(*[F.lit(0.0)] * 5)), vx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()
    assert zero[0] == 1 and math.isnan(zero[1])


@pytest.fixture(scope="module")
def long(spark):
    rows_ = [(0, "a", 1.0), (0, "b", 2.0), (1, "a", 3.0), (2, "c", 0.0), (3, "a", 5.0), (3, "b", 4.0)]
    return spark.createDataFrame(rows_, "id long, name string, value double")


def test_feature_operators(spark, long):
    d = {r["name"]: r for r in features.feature_domain(long).collect()}
    assert set(d) == {"a", "b"} and d["a"].n == 3 and d["a"]["var"] == 4 and d["b"].fid == 1
    assert {(r.id, r.name) for r in features.minimum_cardinality(long, 2).select("id", "name").collect()} == {(0, "a"), (0, "b"), (1, "a"), (3, "a"), (3, "b")}
    dense = features.densify(long, long).collect()
    assert len(dense) == 12 and {r.value for r in dense if (r.id, r["name"]) == (1, "b")} == {0.0}
    assert features.is_dense(long, 2).where("dense").count() == 2
    assert features.validate(long.unionByName(long)).where("valid").count() == 0
    merged = features.merge_duplicates(long.unionByName(long), "ADD")
    assert merged.where("id = 1").first().value == 6
    assert features.minimum_cardinality(long.limit(0), 1).count() == 0
    wide = features.spread(long, "id", ["a", "b"]).where("id = 1").first()
    assert (wide.a, wide.b) == (3.0, 0.0)


def test_transforms(long):
    value = lambda df, i, n: df.where((F.col("id") == i) & (F.col("name") == n)).first().value
    step = transforms.MinMax(-1, 3)
    out = step.apply(long, step.fit(long))
    assert value(out, 1, "a") == 1.0 and value(out, 2, "c") == 2.0  # a constant: (max - min) / 2
    step = transforms.Bins("equal_width", 2)
    assert [value(step.apply(long, step.fit(long)), i, "a") for i in (0, 1, 3)] == [1, 1, 2]
    out = transforms.chain(long, [transforms.Simple("add", 1.0)], {"a": [transforms.Simple("mul", 10.0)]})
    assert value(out, 0, "a") == 11 and value(out, 0, "b") == 3
    with pytest.raises(ValueError):
        transforms.chain(long, [], {"a": [], "[ab]": []})
    idf = transforms.Idf(4)
    assert abs(value(idf.apply(long, idf.fit(long)), 0, "b") - math.log(2) * (1 + math.log(2))) < 1e-12


def test_row_processor(spark):
    df = spark.createDataFrame([("1.5", "x", "a b a", "2020-02-03", "yes ", "r1"), ("bad", "", "", "no", "", "r2"), (None, None, None, None, "no", None)], "num string, cat string, txt string, day string, out string, extra_a string")
    p = rows.RowProcessor(rows.field_response(F.col("out")), {"num": rows.Double(), "cat": rows.Identity(), "txt": rows.Text(2), "day": rows.Date(names=("MONTH", "DAY"))}, {"extra_.*": rows.Regex("r([0-9])", ("MATCH_ALL", "GROUPS"))}, metadata={"n": F.col("cat")})
    out = p.process(df).collect()
    assert len(out) == 1 and out[0].output == "YES" and out[0].weight == 1.0 and out[0].metadata == {"n": "x"}
    got = {f.name: f.value for f in out[0].features}
    assert got == {"num": 1.5, "cat@x": 1.0, "txt@n-1=a": 1.0, "txt@n-1=b": 1.0, "txt@n-2=a/b": 1.0, "txt@n-2=b/a": 1.0, "day@MONTH": 2.0, "day@DAY": 3.0, "extra_a@MATCH_ALL": 1.0, "extra_a@1": 1.0}
    with pytest.raises(ValueError):
        rows.RowProcessor(fields={"num": rows.Double()}, patterns={"num": rows.Double()}).process(df)
    with pytest.raises(ValueError):
        rows.RowProcessor(patterns={"nothing": rows.Double()}).process(df)


def test_text(spark):
    t = spark.createDataFrame([("Hello,  wörld 3.14 a.b",), ("",), (None,)], "t string")
    c = F.col("t")
    got = t.select(text.whitespace_tokens(c).alias("w"), text.character_tokens(c).alias("c"), text.shape_tokens(c).alias("s"), text.universal_tokens(c).alias("u"), text.break_tokens(c).alias("b"), text.pattern_tokens(F.lit(",a,,b"), ",").alias("p")).collect()
    assert got[0].w == ["Hello,", "wörld", "3.14", "a.b"] and got[0].c == ["Hello", "wörld", "3.14", "a", "b"] and got[0].s == ["Hello", ",", "wörld", "3", ".", "14", "a", ".", "b"]
    assert got[0].u[:2] == ["Hello", "wörld"] and got[0].b[:3] == ["Hello", ",", "wörld"] and got[0].p == ["a", "", "b"]
    assert got[1].w == [] and got[2].s is None
    v = ["un", "##aff", "##able", "hello", ","]
    assert text.wordpiece_split("Unaffable héllo, zzz", frozenset(v)) == ["un", "##aff", "##able", "hello", ",", "[UNK]"]
    assert [int(text.murmur3([x], s)[0]) for x, s in (("", 0), ("", 1), ("hello", 0), ("hello, world", 0))] == [0, 0x514E28B7, 0x248BFA47, 0x149BBB7F]
    assert text.murmur3(["hello", "", "hello, world", "hello"]).tolist() == [0x248BFA47, 0, 0x149BBB7F, 0x248BFA47]
    assert text.shape_split("ABc Def12  x__y") == ["ABc", "Def", "12", "x", "__", "y"]
    assert text.universal_split("通以上 通以上") == ["通", "通以", "以", "以上", "上"] * 2
    assert text.universal_split("非常感", bigrams=False) == ["非", "常", "感"] and text.universal_split("非常感", unigrams=False) == ["非常", "常感"]
    assert text.universal_split("a.b 3.1 a4_1.2b Hello!") == ["a", "b", "3", "1", "a4", "1", "2b", "Hello"]
    assert text.universal_split("4:36 PM", marks=True) == ["4", ":", "36", "PM"] and text.universal_split("x" * 300) == ["x" * 256, "x" * 44]
    terms = {(r["name"], r.value) for r in text.term_features(spark.createDataFrame([(1, "a b a")], "id long, t string"), "id", text.whitespace_tokens(F.col("t")), 2).collect()}
    assert terms == {("n-1=a", 2.0), ("n-1=b", 1.0), ("n-2=a/b", 1.0), ("n-2=b/a", 1.0)}
    hashed = text.hash_features(spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "id long, name string, value double"), 1)
    assert [(r["name"], r.value) for r in hashed.collect()] == [("0", 3.0)]
    news = spark.createDataFrame([("From: a\nSubject: b c\n\nbody\nmore",), ("no header",)], "t string").select(text.news(F.col("t")).alias("n")).collect()
    assert news[0].n == "b c\nbody\nmore" and news[1].n is None


def test_sampling(spark):
    df = spark.range(103).repartition(5)
    assert [r.n for r in sampling.train_test(df, [F.col("id")]).groupBy("split").agg(F.count("*").alias("n")).orderBy("split").collect()] == [31, 72]
    folds = sampling.k_folds(df, [F.col("id")], 10).groupBy("fold").agg(F.count("*").alias("n"), F.min("id").alias("lo")).orderBy("fold").collect()
    assert [f.n for f in folds] == [11, 11, 11] + [10] * 7 and [f.lo for f in folds][:4] == [0, 11, 22, 33]
    assert sorted(r.position for r in sampling.position(df, sampling.shuffled(F.col("id"), 3)).collect()) == list(range(103))
    copies = sampling.bootstrap(spark.range(20000), F.col("id"), 1).agg(F.sum("copies"), F.count("*")).first()
    assert abs(copies[0] - 20000) < 600 and abs(copies[1] / 20000 - (1 - math.exp(-1))) < 0.02
    assert sampling.sample_without_replacement(df, F.col("id"), 7, 1).distinct().count() == 7
    assert sampling.cross_validate(df, [F.col("id")], 3, lambda a, b: b.agg(F.count("*").alias("n"))).agg(F.sum("n")).first()[0] == 103


def test_metrics(spark):
    r = random.Random(1)
    data = [(r.choice("abc"), r.choice("abc"), r.random() < 0.4, round(r.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(data, "t string, p string, pos boolean, s double")
    by = {x.label: x for x in metrics.label_metrics(metrics.label_counts(metrics.confusion(df, "t", "p"))).collect()}
    for l in "abc":
        tp, fp, fn = (sum(f(t, p) for t, p, *_ in data) for f in (lambda t, p: t == p == l, lambda t, p: t != l == p, lambda t, p: p != l == t))
        assert (by[l].tp, by[l].fp, by[l].fn, by[l].tn) == (tp, fp, fn, 300 - tp - fp - fn) and abs(by[l].precision - tp / (tp + fp)) < 1e-12
    area = metrics.auroc(metrics.roc_points(df, F.col("pos"), F.col("s"))).first().auroc
    p, n = [x[3] for x in data if x[2]], [x[3] for x in data if not x[2]]
    assert abs(area - sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n)) < 1e-9
    empty = metrics.anomaly(df.where("s > 9"), F.col("pos"), F.col("pos")).first()
    assert empty.precision is None or math.isnan(empty.precision)
    same = metrics.clustering(df, "t", "t").first()
    assert abs(same.nmi - 1) < 1e-9 and abs(same.ami - 1) < 1e-9


def test_information(spark):
    r = random.Random(2)
    data = [(x := r.randrange(3), (x + r.randrange(2)) % 3, r.randrange(2)) for _ in range(400)]
    df = spark.createDataFrame(data, "x int, y int, z int")

    def h(*cols):
        c = Counter(tuple(d["xyz".index(k)] for k in cols) for d in data)
        return -sum(n / 400 * math.log2(n / 400) for n in c.values())

    assert abs(infotheory.entropy(df, ["x", "y"]).first().h - h("x", "y")) < 1e-9
    assert abs(infotheory.conditional_entropy(df, ["x"], ["y"]).first().h - (h("x", "y") - h("y"))) < 1e-9
    assert abs(infotheory.mutual_information(df, ["x"], ["y"]).first().mi - (h("x") + h("y") - h("x", "y"))) < 1e-9
    assert abs(infotheory.conditional_mutual_information(df, ["x"], ["y"], ["z"]).first().cmi - (h("x", "z") + h("y", "z") - h("x", "y", "z") - h("z"))) < 1e-9
    assert infotheory.mutual_information(df.limit(0), ["x"], ["y"]).first().mi == 0
    assert abs(infotheory.regularised_gamma_p(1, 2) - (1 - math.exp(-2))) < 1e-12 and abs(infotheory.regularised_gamma_p(0.5, 0.5) - math.erf(math.sqrt(0.5))) < 1e-12


def test_neighbours(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(120, 3)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0, 2.0, 3.0]), (500, None)], "vec_id long, embedding array<double>")
    for kind in ("L1", "L2", "COSINE"):
        got = {(g.probe, g["rank"]): g.neighbour for g in neighbours.k_nearest(df.where("vec_id < 9"), df, 4, distance=kind).collect()}
        for q in range(9):
            d = {"L1": abs(x - x[q]).sum(1), "L2": np.sqrt(((x - x[q]) ** 2).sum(1)), "COSINE": 1 - x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])}[kind]
            assert np.allclose(sorted(d)[:4], [d[got[q, k]] for k in range(1, 5)])
    assert neighbours.k_nearest(df.where("vec_id < 2"), df.where("vec_id < 3"), 10).count() == 6


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿A,B,R\n1,"x, ""y""",up\n\n2,z,down\n')
    out = readers.read_delimited(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in out] == [("1", 'x, "y"', "up"), ("2", "z", "down")]
    (tmp_path / "n.csv").write_text("1.5,a\n2,b\n")
    assert readers.read_numeric(spark, str(tmp_path / "n.csv"), ["r"], header=["x", "r"]).collect()[0].x == 1.5
    (tmp_path / "j.json").write_text('[{"b": 1, "a": "x", "c": {"d": 2}}, {"b": null, "a": "y"}]')
    assert [tuple(r) for r in readers.read_json_array(spark, str(tmp_path / "j.json")).collect()][0][:2] == ("x", "1")
    (tmp_path / "s.libsvm").write_text("1 1:0.5 12:2 # note\n-1 3:1\n")
    svm = readers.read_libsvm(spark, str(tmp_path / "s.libsvm")).collect()
    assert svm[0].features == {"00": 0.5, "11": 2.0} and svm[1].output == "-1"
    (tmp_path / "t.txt").write_text("pos##good day\nbad line\nneg## \n")
    assert [tuple(r) for r in readers.read_labelled_text(spark, str(tmp_path / "t.txt")).collect()] == [("POS", "good day")]
    images, labels = np.arange(12, dtype=np.uint8).reshape(3, 2, 2), np.array([7, 8, 9], np.uint8)
    (tmp_path / "x.idx").write_bytes(writers.encode_idx(images))
    (tmp_path / "y.idx").write_bytes(writers.encode_idx(labels))
    idx = {r.output: r.features for r in readers.read_idx(spark, str(tmp_path / "x.idx"), str(tmp_path / "y.idx")).collect()}
    assert idx["7"] == {"00001": 1.0, "00002": 2.0, "00003": 3.0} and set(idx) == {"7", "8", "9"}
    with pytest.raises(ValueError):
        readers.decode_idx(writers.encode_idx(images)[:-1])
    (tmp_path / "d" / "spam").mkdir(parents=True)
    (tmp_path / "d" / "spam" / "1.txt").write_text("two\nlines")
    assert readers.read_directories(spark, str(tmp_path / "d")).first()[:2] == ("SPAM", "two\nlines")


def test_models(spark):
    df = synthetic.two_gaussians(spark, 400, second=((4.0, 4.0), 1.0)).cache()
    right = lambda p, c: p.where(F.col(c) == F.col("label")).count() / 400
    assert right(models.classifier(df, ["x", "y"], "label").transform(df), "prediction_label") > 0.95
    for fit in (models.bagging, models.samme):
        assert right(fit(df, ["x", "y"], "label", 3, "id", maxDepth=2)(df).join(df, "id"), "prediction") > 0.95
    line = synthetic.linear_regression(spark, 300, [2.0, -1.0], 3.0, 0.1)
    m = models.regressor(line, ["x0", "x1"], "y").stages[-1]
    assert np.allclose([*m.coefficients, m.intercept], [2, -1, 3], atol=0.05)
    sets = synthetic.multilabels(spark, 200, ["a", "b"])
    for predict in (models.independent_multilabel(sets, ["x0", "x1"], "labels", ["a", "b"]), models.classifier_chain(sets, ["x0", "x1"], "labels", ["b", "a"])):
        assert predict(sets).where(F.array_sort("labels") == F.col("predicted_labels")).count() > 180
    clusters = synthetic.gaussian_clusters(spark, 200, [[0.0, 0.0], [9.0, 9.0]], [1, 1])
    assert models.kmeans(clusters, ["x0", "x1"], 2).transform(clusters).groupBy("cluster", "prediction").count().count() == 2


def test_naive_bayes_and_combiners(spark):
    long = spark.createDataFrame([(0, "a", 2.0), (0, "b", 1.0), (1, "b", 3.0), (2, "a", 1.0)], "id long, name string, value double")
    labels = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "id long, label string")
    scores = {(r.id, r.label): r.score for r in baselines.mnb_score(long, baselines.mnb_fit(long, labels)).collect()}
    assert abs(scores[0, "x"] - (2 * math.log(4 / 6) + math.log(2 / 6))) < 1e-12 and abs(scores[2, "y"] - math.log(1 / 5)) < 1e-12
    votes = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (2, "b", 3.0)], "id long, p string, v double")
    assert {(r.id, r.prediction) for r in baselines.vote(votes, "id", "p").collect()} == {(1, "a"), (2, "b")}
    mean = {r.id: (r["mean"], r.variance) for r in baselines.average(votes, "id", "v").collect()}
    assert mean == {1: (1.0, 0.0), 2: (3.0, 0.0)}
    five = spark.createDataFrame([(float(v),) for v in (5, 1, 4, 2, 3, 3)], "v double")
    assert [baselines.dummy_regressor(five, "v", k, q).first().value for k, q in (("MEDIAN", 0.5), ("QUARTILE", 0.25), ("MEAN", 0))] == [3.0, 2.0, 3.0]


def test_streaming_matches_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = online.stream_of(spark, str(tmp_path / "e"), events)
    got = online.run_to_memory(online.tumbling(stream, "ts", "1 day", ["event_type"]), "tumbling_days")
    want = online.tumbling(events, "ts", "1 day", ["event_type"])
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(got) == key(want)
    counts = online.run_to_memory(online.online_confusion(online.stream_of(spark, str(tmp_path / "e"), events), "event_type", "event_type"), "online_counts")
    assert sum(r.n for r in counts.collect()) == events.count()
