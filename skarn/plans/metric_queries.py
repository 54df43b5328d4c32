"""Evaluation metrics and information theory over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import infotheory as it
from skarn.operators import metrics as mx
from skarn.plans.feature_queries import LINE, table


def _rule(spark, sf_dir):
    """labels with a rule's prediction (long documents are good) and its score."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").cast("string").alias("truth"), F.when(F.col("n_chars") > 500, "1").otherwise("0").alias("predicted"), F.col("n_chars").cast("double").alias("score"))


_RULE = "r AS (SELECT l.doc_id, CAST(l.quality AS VARCHAR) AS truth, CASE WHEN d.n_chars > 500 THEN '1' ELSE '0' END AS predicted, CAST(d.n_chars AS DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id))"
_COUNTS = """k AS (SELECT DISTINCT truth AS label FROM r UNION SELECT DISTINCT predicted FROM r),
c AS (SELECT label, CAST(sum(CASE WHEN truth = label AND predicted = label THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN truth <> label AND predicted = label THEN 1 ELSE 0 END) AS BIGINT) AS fp,
 CAST(sum(CASE WHEN truth = label AND predicted <> label THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN truth <> label AND predicted <> label THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN truth = label THEN 1 ELSE 0 END) AS BIGINT) AS support FROM r CROSS JOIN k GROUP BY label),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall FROM c)"""
_F1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END"


def confusion_matrix(spark, sf_dir):
    return mx.confusion(_rule(spark, sf_dir), "truth", "predicted")


def prf_per_label(spark, sf_dir):
    m = mx.label_metrics(mx.label_counts(mx.confusion(_rule(spark, sf_dir), "truth", "predicted")))
    return m.select("label", "tp", "fp", "fn", "tn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall")], F.round("f", 6).alias("f1"))


def prf_averages(spark, sf_dir):
    a = mx.averages(mx.label_counts(mx.confusion(_rule(spark, sf_dir), "truth", "predicted")))
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


def _points(spark, sf_dir):
    r = _rule(spark, sf_dir)
    return mx.roc_points(r, F.col("truth") == "1", F.col("score"))


def roc_points(spark, sf_dir):
    return _points(spark, sf_dir).select("threshold", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"))


def auroc(spark, sf_dir):
    return mx.auroc(_points(spark, sf_dir)).select(F.round("auroc", 6).alias("auroc"))


def pr_points(spark, sf_dir):
    return mx.pr_points(_points(spark, sf_dir)).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def average_precision(spark, sf_dir):
    return mx.average_precision(_points(spark, sf_dir)).select(F.round("average_precision", 6).alias("average_precision"))


_ROC = f"""WITH {_RULE}, b AS (SELECT score AS threshold, sum(CASE WHEN truth = '1' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN truth = '1' THEN 0 ELSE 1 END) AS q FROM r GROUP BY score),
s AS (SELECT threshold, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM b WINDOW w AS (ORDER BY threshold DESC))"""


def regression_metrics(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    m = mx.regression(line, F.col("l_extendedprice"), F.col("l_quantity") * 1500.0, by=["l_returnflag"])
    return m.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "r2", "explained_variance")])


def anomaly_metrics(spark, sf_dir):
    a = mx.anomaly(table(spark, sf_dir, "events"), F.col("event_type") == "error", F.col("value") > 20)
    return a.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _label_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda r: F.array_sort(F.array_compact(F.collect_set(F.when(F.col("event_id") % 2 == r, F.col("event_type")))))
    return e.groupBy("user_id").agg(side(0).alias("truth"), side(1).alias("predicted"))


def jaccard_multilabel(spark, sf_dir):
    from skarn.functions.vectors import jaccard

    return _label_sets(spark, sf_dir).select("user_id", F.round(jaccard(F.col("truth"), F.col("predicted")), 6).alias("jaccard")).where("NOT isnan(jaccard)")


def multilabel_counts(spark, sf_dir):
    return mx.multilabel_counts(_label_sets(spark, sf_dir), "truth", "predicted")


def clustering_metrics(spark, sf_dir):
    from skarn.functions.vectors import arg_max

    e = table(spark, sf_dir, "embeddings").select("label", arg_max(F.col("embedding")).alias("top"))
    m = mx.clustering(e, "label", "top")
    return m.select(F.round("nmi", 6).alias("nmi"), F.round("ami", 6).alias("ami"))


def _orders(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderpriority", "o_orderstatus", "c_mktsegment")


_ORD = "o AS (SELECT o_orderpriority AS x, o_orderstatus AS y, c_mktsegment AS z FROM orders JOIN customer ON o_custkey = c_custkey)"


def entropies(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumnsRenamed({"o_orderpriority": "x", "o_orderstatus": "y", "c_mktsegment": "z"})
    rows = [("h_x", it.entropy(o, ["x"]), "h"), ("h_xy", it.entropy(o, ["x", "y"]), "h"), ("h_x_given_y", it.conditional_entropy(o, ["x"], ["y"]), "h"), ("mi_xy", it.mutual_information(o, ["x"], ["y"]), "mi"), ("mi_xy_z", it.mutual_information(o, ["x", "y"], ["z"]), "mi"), ("cmi_xy_given_z", it.conditional_mutual_information(o, ["x"], ["y"], ["z"]), "cmi")]
    out = None
    for name, df, c in rows:
        part = df.select(F.lit(name).alias("statistic"), F.round(F.col(c), 6).alias("bits"))
        out = part if out is None else out.unionByName(part)
    return out


def _h(cols):
    return f"(SELECT sum(-n / t * log2(n / t)) FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t FROM o GROUP BY {cols}))"


_ENTROPY = f"""WITH {_ORD}, h AS (SELECT {_h('x')} AS x, {_h('y')} AS y, {_h('z')} AS z, {_h('x, y')} AS xy, {_h('x, z')} AS xz, {_h('y, z')} AS yz, {_h('x, y, z')} AS xyz)
SELECT 'h_x' AS statistic, round(x, 6) AS bits FROM h UNION ALL SELECT 'h_xy', round(xy, 6) FROM h UNION ALL SELECT 'h_x_given_y', round(xy - y, 6) FROM h
UNION ALL SELECT 'mi_xy', round(x + y - xy, 6) FROM h UNION ALL SELECT 'mi_xy_z', round(xy + z - xyz, 6) FROM h UNION ALL SELECT 'cmi_xy_given_z', round(xz + yz - xyz - z, 6) FROM h"""


def weighted_information(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    h = it.entropy(line, ["l_returnflag"], "l_quantity").select(F.lit("weighted_entropy").alias("statistic"), F.round("h", 4).alias("bits"))
    m = it.mutual_information(line, ["l_returnflag"], ["l_linestatus"], "l_quantity").select(F.lit("weighted_mi").alias("statistic"), F.round("mi", 4).alias("bits"))
    return h.unionByName(m)


def g_statistic(spark, sf_dir):
    g = it.g_statistic(_orders(spark, sf_dir), "o_orderpriority", "c_mktsegment")
    return g.select(F.round("g", 4).alias("g"), "dof")


def mim_rank(spark, sf_dir):
    from skarn.operators.features import melt

    m = it.mim(melt(table(spark, sf_dir, "lineitem"), ["l_returnflag"], LINE), "l_returnflag")
    return m.select("name", F.round("mi", 6).alias("mi"))


_MIM = "WITH m AS (" + " UNION ALL ".join(f"SELECT l_returnflag AS y, '{c}' AS name, {c} AS v FROM lineitem" for c in LINE) + """),
f AS (SELECT name, min(v) AS lo, max(v) AS hi FROM m GROUP BY name),
b AS (SELECT name, y, CAST(least(10, """ + " + ".join(f"CASE WHEN v > lo + (hi - lo) * {i} / 10 THEN 1 ELSE 0 END" for i in range(1, 11)) + """ + 1) AS INTEGER) AS bin FROM m JOIN f USING (name)),
c AS (SELECT name, bin, y, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2, 3),
t AS (SELECT name, n, sum(n) OVER (PARTITION BY name, bin) AS nx, sum(n) OVER (PARTITION BY name, y) AS ny, sum(n) OVER (PARTITION BY name) AS total FROM c)
SELECT name, round(sum(n / total * log2(n * total / (nx * ny))), 6) AS mi FROM t GROUP BY name"""


def greedy_selection(spark, sf_dir):
    """The features in the order in which each criterion takes them."""
    from skarn.operators.features import melt

    line = table(spark, sf_dir, "lineitem").withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", *LINE))
    rows = []
    for how in ("JMI", "mRMR", "CMIM"):
        for i, (name, score) in enumerate(it.greedy_selection(melt(line, ["id", "l_returnflag"], LINE), "id", "l_returnflag", how, 3)):
            rows.append((how, i + 1, name, round(score, 6)))
    return spark.createDataFrame(rows, "criterion string, place int, name string, score double")


QUERIES = {
    "confusion_matrix": (confusion_matrix, f"WITH {_RULE} SELECT truth, predicted, count(*) AS n FROM r GROUP BY 1, 2"),
    "prf_per_label": (prf_per_label, f"WITH {_RULE}, {_COUNTS} SELECT label, tp, fp, fn, tn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM p"),
    "prf_averages": (prf_averages, f"WITH {_RULE}, {_COUNTS}, a AS (SELECT sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(support)::DOUBLE AS s, avg(precision) AS mp, avg(recall) AS mr, avg({_F1}) AS mf FROM p) SELECT round(tp / (tp + fp), 6) AS micro_precision, round(tp / (tp + fn), 6) AS micro_recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS micro_f1, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(tp / s, 6) AS accuracy, round(1 - mr, 6) AS balanced_error_rate FROM a"),
    "roc_points": (roc_points, f"{_ROC} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM s"),
    "auroc": (auroc, f"{_ROC} SELECT round(sum(q * (tp - p / 2.0::DOUBLE)) / (max(np) * max(nq)), 6) AS auroc FROM s"),
    "pr_points": (pr_points, f"{_ROC} SELECT threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / np, 6) AS recall FROM s WHERE tp - p < np"),
    "average_precision": (average_precision, f"{_ROC} SELECT round(sum(p::DOUBLE / np * (tp::DOUBLE / (tp + fp))), 6) AS average_precision FROM s WHERE tp - p < np"),
    "regression_metrics": (regression_metrics, "WITH e AS (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - l_quantity * 1500.0::DOUBLE AS e FROM lineitem) SELECT l_returnflag, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - avg(e * e) / (avg(y * y) - avg(y) * avg(y)), 4) AS r2, round(1 - (avg(e * e) - avg(e) * avg(e)) / (avg(y * y) - avg(y) * avg(y)), 4) AS explained_variance FROM e GROUP BY 1"),
    "anomaly_metrics": (anomaly_metrics, "WITH c AS (SELECT CAST(count(*) FILTER (event_type = 'error' AND value > 20) AS BIGINT) AS tp, count(*) FILTER (event_type <> 'error' AND value > 20) AS fp, count(*) FILTER (event_type <> 'error' AND value <= 20) AS tn, count(*) FILTER (event_type = 'error' AND value <= 20) AS fn FROM events) SELECT tp, fp, tn, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)), 6) AS f1 FROM c"),
    "jaccard_multilabel": (jaccard_multilabel, "WITH s AS (SELECT user_id, event_type, max(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END) AS b FROM events GROUP BY 1, 2) SELECT user_id, round(sum(a * b)::DOUBLE / count(*), 6) AS jaccard FROM s GROUP BY 1"),
    "multilabel_counts": (multilabel_counts, "WITH s AS (SELECT user_id, event_type, max(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END) AS b FROM events GROUP BY 1, 2), c AS (SELECT event_type AS label, CAST(sum(a * b) AS BIGINT) AS tp, CAST(sum((1 - a) * b) AS BIGINT) AS fp, CAST(sum(a * (1 - b)) AS BIGINT) AS fn FROM s GROUP BY 1) SELECT label, tp, fp, fn, (SELECT count(DISTINCT user_id) FROM events) - tp - fp - fn AS tn, tp + fn AS support FROM c"),
    "clustering_metrics": (clustering_metrics, None),
    "entropies": (entropies, _ENTROPY),
    "weighted_information": (weighted_information, """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS n, sum(l_quantity) / count(*) AS w FROM lineitem GROUP BY 1, 2),
      a AS (SELECT l_returnflag AS x, count(*)::DOUBLE AS n, sum(l_quantity) / count(*) AS w FROM lineitem GROUP BY 1),
      t AS (SELECT x, y, n, w, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS total FROM c)
      SELECT 'weighted_entropy' AS statistic, round((SELECT sum(-w * n / s * log2(n / s)) FROM (SELECT *, sum(n) OVER () AS s FROM a)), 4) AS bits
      UNION ALL SELECT 'weighted_mi', round(sum(w * n / total * log2(n * total / (nx * ny))), 4) FROM t"""),
    "g_statistic": (g_statistic, f"WITH {_ORD}, c AS (SELECT x, z, count(*)::DOUBLE AS n FROM o GROUP BY 1, 2), t AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY z) AS nz, sum(n) OVER () AS total FROM c) SELECT round(2 * sum(n * ln(n * total / (nx * nz))), 4) AS g, (SELECT CAST((count(DISTINCT x) - 1) * (count(DISTINCT z) - 1) AS BIGINT) FROM o) AS dof FROM t"),
    "mim_rank": (mim_rank, _MIM),
    "greedy_selection": (greedy_selection, None),
}
