"""Domains, selection, transforms, row processing and sampling over the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions.scalars import DATE_FEATURES, date_features, java_hash, quartile_bucket, week_of_month  # noqa: F401
from skarn.operators import features as fx
from skarn.operators import rows as rp
from skarn.operators import sampling as sm
from skarn.operators import transforms as tr
from skarn.sources.readers import parse_labelled_text, parse_libsvm, round_robin
from skarn.sources.writers import libsvm_line

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark, sf_dir, name, spread=False):
    """A table; ``spread`` deals a file of fewer pieces than there are cores to all of them, for work that is much longer than reading."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if spread and df.rdd.getNumPartitions() <= cores else df


def _line(spark, sf_dir):
    """lineitem's numbers in long form, keyed by order and line."""
    return fx.melt(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], LINE)


_MELT = "m AS (" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_returnflag, '{c}' AS name, {c} AS value FROM lineitem" for c in LINE) + ")"


def scale_minmax(spark, sf_dir):
    long = fx.melt(table(spark, sf_dir, "lineitem"), ["l_returnflag"], LINE)
    step = tr.MinMax()
    return step.apply(long, step.fit(long)).groupBy("name", "l_returnflag").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def feature_domain(spark, sf_dir):
    d = fx.feature_domain(_line(spark, sf_dir))
    return d.select(F.col("fid").cast("int").alias("fid"), "name", "n", "n_distinct", "min", "max", F.round("mean", 4).alias("mean"), F.round("var", 4).alias("var"))


def categorical_histogram(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = lambda c: fx.histogram(p, c).select(F.lit(c).alias("feature"), "value", "n")
    return one("p_brand").unionByName(one("p_type"))


def output_domain(spark, sf_dir):
    return fx.output_domain(table(spark, sf_dir, "events"), "event_type").select(F.col("oid").cast("int").alias("oid"), "output", "n")


def min_cardinality(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p_size@"), F.col("p_size").cast("string")).alias("name"), F.lit(1.0).alias("value"))
    return fx.minimum_cardinality(f, 40).groupBy("name").agg(F.count("*").alias("n"))


def removed_features(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p_size@"), F.col("p_size").cast("string")).alias("name"), F.lit(1.0).alias("value"))
    return fx.removed_features(f, 40)


def densify(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    f = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("c_mktsegment@"), "c_mktsegment").alias("name"), F.lit(1.0).alias("value"))
    d = fx.densify(f, f.select("name").distinct())
    return d.groupBy("name").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("ones"))


def _transform_summary(step_for, digits=6):
    def run(spark, sf_dir):
        long = _line(spark, sf_dir)
        step = step_for()
        out = step.apply(long, step.fit(long))
        return out.groupBy("name").agg(F.round(F.avg("value"), digits).alias("mean"), F.round(F.min("value"), digits).alias("min"), F.round(F.max("value"), digits).alias("max"), F.count("*").alias("n"))

    return run


def bins(kind):
    def run(spark, sf_dir):
        long = _line(spark, sf_dir)
        step = tr.Bins(kind, 4)
        return step.apply(long, step.fit(long)).groupBy("name", F.col("value").cast("int").alias("bin")).agg(F.count("*").alias("n"))

    return run


_SUMMARY = "SELECT name, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM t GROUP BY name"


def date_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *date_features(F.col("o_orderdate")))


_DATES = """
SELECT o_orderkey, CAST(isodow(d) AS INTEGER) AS day_of_week, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
  CAST((day(d) + isodow(date_trunc('month', d)) - 2) // 7 + CASE WHEN isodow(date_trunc('month', d)) <= 4 THEN 1 ELSE 0 END AS INTEGER) AS week_of_month,
  CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(dayofyear(d) % 2 AS INTEGER) AS even_or_odd_day,
  CAST(weekofyear(d) % 2 AS INTEGER) AS even_or_odd_week, CAST(month(d) % 2 AS INTEGER) AS even_or_odd_month,
  CAST(year(d) % 2 AS INTEGER) AS even_or_odd_year, CAST(quarter(d) AS INTEGER) AS calendar_quarter,
  CAST(date_diff('day', CAST(date_trunc('quarter', d) AS DATE), d) + 1 AS INTEGER) AS day_of_quarter,
  CAST(day(d) AS INTEGER) AS day, CAST(month(d) AS INTEGER) AS month, CAST(year(d) AS INTEGER) AS year
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
"""


def row_processor(spark, sf_dir):
    """part rows to examples: a number, a category, a pattern's groups; response from the brand."""
    p = rp.RowProcessor(
        response=rp.field_response(F.col("p_brand")),
        fields={"p_size": rp.Double(), "p_type": rp.Identity(), "p_name": rp.Regex("part.*", ("MATCH_CONTAINS",))},
        patterns={"p_retail.*": rp.Double(only_name=False)},
        weight=F.col("p_size"),
    )
    out = p.process(table(spark, sf_dir, "part")).select("output", F.explode("features").alias("f"))
    return out.groupBy("output", F.col("f.name").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("f.value"), 3).alias("total"))


_ROWS = """
WITH f AS (
  SELECT upper(trim(p_brand)) AS output, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part
  UNION ALL SELECT upper(trim(p_brand)), 'p_type@' || p_type, 1.0 FROM part
  UNION ALL SELECT upper(trim(p_brand)), 'p_name@MATCH_CONTAINS', 1.0 FROM part WHERE regexp_matches(p_name, 'part.*')
  UNION ALL SELECT upper(trim(p_brand)), 'p_retailprice@value', p_retailprice FROM part)
SELECT output, name, count(*) AS n, round(sum(value), 3) AS total FROM f GROUP BY output, name
"""


def responses(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    q = quartile_bucket(F.col("o_totalprice"), 50000.0, 150000.0, 250000.0)
    return o.select(rp.binary_response(F.col("o_orderstatus"), "F").alias("binary"), q.alias("quartile"), rp.field_response(F.col("o_orderpriority")).alias("field")).groupBy("binary", "quartile", "field").agg(F.count("*").alias("n"))


def unique_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = fx.unique_by_order(e, ["user_id", "event_type"], "event_id", "value")
    return u.select("user_id", "event_type", "first", "last", "max", "min", F.round("sum", 6).alias("sum"), "n")


def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def train_test_split(spark, sf_dir):
    o = sm.train_test(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")])
    return o.groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def k_fold(spark, sf_dir):
    o = sm.k_folds(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], 7)
    return o.groupBy("fold").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


def aggregate_round_robin(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return round_robin([c, s], [[F.col("key")], [F.col("key")]]).select("turn", "source", "key", "name")


def descriptive(spark, sf_dir):
    d = fx.descriptive_stats(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return d.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")])


def weighted_means(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(fx.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("wmean"))


def libsvm_lines(spark, sf_dir):
    """Written and parsed again: the sums of what comes back."""
    line = table(spark, sf_dir, "lineitem").select(libsvm_line(F.col("l_returnflag"), LINE).alias("value"))
    back = parse_libsvm(line)
    return back.select("output", F.explode("features").alias("i", "v")).groupBy("output", "i").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


def labelled_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("##", "role", "text").alias("value"))
    return parse_labelled_text(c).groupBy("output").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def known_domain(spark, sf_dir):
    """Keys that only orders' customers have, and those that only suppliers have."""
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("name"))
    return fx.domain_difference(c, s)


def selected_features(spark, sf_dir):
    """The two features of greatest variance."""
    long = _line(spark, sf_dir)
    ranked = fx.feature_domain(long).select("name", F.col("var").alias("score"))
    return fx.select_features(long, ranked, 2).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def cv_summary(spark, sf_dir):
    """Mean price by fold, summed up over folds."""
    from skarn.operators.metrics import summary

    o = sm.k_folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], 5)
    by = o.groupBy("fold").agg(F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"))
    s = summary(by, ["mean_price", "max_price"])
    return s.select("metric", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")])


QUERIES = {
    "scale_minmax": (scale_minmax, f"""WITH {_MELT}, f AS (SELECT name, min(value) AS lo, max(value) AS hi FROM m GROUP BY name)
      SELECT name, l_returnflag, round(avg(CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END), 6) AS mean, count(*) AS n FROM m JOIN f USING (name) GROUP BY name, l_returnflag"""),
    "feature_domain": (feature_domain, f"""WITH {_MELT} SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS fid, name, count(*) AS n, count(DISTINCT value) AS n_distinct,
      min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS var FROM m WHERE value <> 0 GROUP BY name"""),
    "categorical_histogram": (categorical_histogram, "SELECT 'p_brand' AS feature, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type"),
    "output_domain": (output_domain, "SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS oid, event_type AS output, count(*) AS n FROM events GROUP BY event_type"),
    "min_cardinality": (min_cardinality, "SELECT 'p_size@' || p_size AS name, count(*) AS n FROM part GROUP BY p_size HAVING count(*) >= 40"),
    "removed_features": (removed_features, "SELECT 'p_size@' || p_size AS name, count(*) AS n FROM part GROUP BY p_size HAVING count(*) < 40"),
    "densify": (densify, "SELECT 'c_mktsegment@' || d.s AS name, count(*) AS n, CAST(sum(CASE WHEN c.c_mktsegment = d.s THEN 1 ELSE 0 END) AS BIGINT) AS ones FROM customer c CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer) d GROUP BY d.s"),
    "standardise": (_transform_summary(tr.Standardise), f"WITH {_MELT}, f AS (SELECT name, avg(value) AS a, stddev_samp(value) AS s FROM m GROUP BY name), t AS (SELECT name, (value - a) / s AS v FROM m JOIN f USING (name)) SELECT name, round(avg(v), 6) + 0.0 AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM t GROUP BY name"),
    "binarise": (_transform_summary(lambda: tr.Simple("binarise")), f"WITH {_MELT}, t AS (SELECT name, CASE WHEN value < 1e-12 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM m) {_SUMMARY}"),
    "clamp": (_transform_summary(lambda: tr.Simple("threshold", 0.03, 30.0)), f"WITH {_MELT}, t AS (SELECT name, least(greatest(value, 0.03::DOUBLE), 30.0::DOUBLE) AS v FROM m) {_SUMMARY}"),
    "simple_ops": (_transform_summary(lambda: tr.Simple("mul", 2.0)), f"WITH {_MELT}, t AS (SELECT name, value * 2.0::DOUBLE AS v FROM m) {_SUMMARY}"),
    "bin_equal_width": (bins("equal_width"), f"WITH {_MELT}, f AS (SELECT name, min(value) AS lo, max(value) AS hi FROM m GROUP BY name) SELECT name, CAST(CASE WHEN value <= lo + (hi - lo) * 1 / 4 THEN 1 WHEN value <= lo + (hi - lo) * 2 / 4 THEN 2 WHEN value <= lo + (hi - lo) * 3 / 4 THEN 3 ELSE 4 END AS INTEGER) AS bin, count(*) AS n FROM m JOIN f USING (name) GROUP BY 1, 2"),
    "bin_equal_freq": (bins("equal_frequency"), f"""WITH {_MELT}, r AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY name) AS c FROM m),
      e AS (SELECT name, max(CASE WHEN i = c // 4 THEN value END) AS e1, max(CASE WHEN i = 2 * (c // 4) THEN value END) AS e2, max(CASE WHEN i = 3 * (c // 4) THEN value END) AS e3 FROM r GROUP BY name)
      SELECT name, CAST(CASE WHEN value <= e1 THEN 1 WHEN value <= e2 THEN 2 WHEN value <= e3 THEN 3 ELSE 4 END AS INTEGER) AS bin, count(*) AS n FROM m JOIN e USING (name) GROUP BY 1, 2"""),
    "bin_stddev": (bins("std_devs"), f"WITH {_MELT}, f AS (SELECT name, avg(value) AS a, stddev_samp(value) AS s FROM m GROUP BY name) SELECT name, CAST(CASE WHEN value <= a - s THEN 1 WHEN value <= a THEN 2 WHEN value <= a + s THEN 3 ELSE 4 END AS INTEGER) AS bin, count(*) AS n FROM m JOIN f USING (name) GROUP BY 1, 2"),
    "date_features": (date_query, _DATES),
    "row_processor": (row_processor, _ROWS),
    "responses": (responses, "SELECT CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS \"binary\", CASE WHEN o_totalprice <= 50000 THEN 'Q1' WHEN o_totalprice <= 150000 THEN 'Q2' WHEN o_totalprice <= 250000 THEN 'Q3' ELSE 'Q4' END AS quartile, upper(trim(o_orderpriority)) AS field, count(*) AS n FROM orders GROUP BY 1, 2, 3"),
    "unique_values": (unique_values, "SELECT user_id, event_type, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, max(value) AS max, min(value) AS min, round(sum(value), 6) AS sum, count(*) AS n FROM events GROUP BY user_id, event_type"),
    "json_props": (json_props, "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1"),
    "train_test_split": (train_test_split, "WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS c FROM orders) SELECT CASE WHEN i < CAST(floor(0.7 * c) AS BIGINT) THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, round(sum(o_totalprice), 2) AS total FROM r GROUP BY 1"),
    "k_fold": (k_fold, "WITH r AS (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS fold FROM orders) SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM r GROUP BY fold"),
    "aggregate_round_robin": (aggregate_round_robin, "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS turn, 0 AS source, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey) - 1, 1, s_suppkey, s_name FROM supplier"),
    "descriptive_stats": (descriptive, "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max FROM orders GROUP BY 1"),
    "weighted_mean": (weighted_means, "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS wmean FROM lineitem GROUP BY 1"),
    "libsvm_round_trip": (libsvm_lines, "SELECT l_returnflag AS output, i, count(*) AS n, round(sum(v), 2) AS total FROM (" + " UNION ALL ".join(f"SELECT l_returnflag, {i + 1} AS i, {c} AS v FROM lineitem WHERE {c} <> 0" for i, c in enumerate(LINE)) + ") GROUP BY 1, 2"),
    "labelled_text": (labelled_text, "SELECT upper(trim(role)) AS output, count(*) AS n, CAST(sum(length(trim(text))) AS BIGINT) AS chars FROM conversations WHERE trim(text) <> '' GROUP BY 1"),
    "domain_difference": (known_domain, "WITH c AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS name FROM orders), s AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS name FROM supplier) SELECT name, 'first' AS side FROM c WHERE name NOT IN (SELECT name FROM s) UNION ALL SELECT name, 'second' FROM s WHERE name NOT IN (SELECT name FROM c)"),
    "selected_features": (selected_features, f"WITH {_MELT}, t AS (SELECT name FROM m WHERE value <> 0 GROUP BY name ORDER BY var_samp(value) DESC, name LIMIT 2) SELECT name, count(*) AS n, round(sum(value), 2) AS total FROM m WHERE name IN (SELECT name FROM t) GROUP BY name"),
    "cv_summary": (cv_summary, "WITH r AS (SELECT o_totalprice, ntile(5) OVER (ORDER BY o_orderkey) AS f FROM orders), b AS (SELECT f, avg(o_totalprice) AS a, max(o_totalprice) AS x FROM r GROUP BY f), l AS (SELECT 'mean_price' AS metric, a AS v FROM b UNION ALL SELECT 'max_price', x FROM b) SELECT metric, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max FROM l GROUP BY metric"),
}
