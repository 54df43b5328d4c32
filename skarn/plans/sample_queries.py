"""Index views, cumulative shares and draws from them, sequences' features, typed tokens, matrices, the best evaluation, extra trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import features as fx
from skarn.operators import matrix, metrics, sampling, text, trees
from skarn.plans.feature_queries import table
from skarn.plans.learner_queries import _accuracy, _points


def index_view(spark, sf_dir):
    """Orders at the positions that customers' nations and account numbers make, some more than once."""
    at = table(spark, sf_dir, "customer").select((F.col("c_nationkey") * 7).alias("position"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.at_positions(o, [F.col("o_orderkey")], at).groupBy("position", "o_orderkey", "o_orderstatus").agg(F.count("*").alias("n"))


def cumulative_shares(spark, sf_dir):
    by = fx.histogram(table(spark, sf_dir, "lineitem"), "l_quantity")
    return sampling.cumulative(by, [F.col("value")], F.col("n")).select("value", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def weighted_bootstrap(spark, sf_dir):
    """As many draws as there are lines, by their price: how many fall to each flag."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")]
    return sampling.weighted_bootstrap(line, order, F.col("l_extendedprice"), line.count(), 1).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def sampled_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IS NOT NULL")
    n = e.count()
    some = lambda by: sampling.sample_values(e, "event_type", n, 1, by).groupBy("value").agg(F.count("*").alias("n")).withColumn("by_frequency", F.lit(by))
    return some(False).unionByName(some(True))


def sequence_min_cardinality(spark, sf_dir):
    """What conversations keep of their turns' words when rare words go."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    words = c.select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.explode(F.split("text", " ")).alias("name")).where("name <> ''").distinct()
    return fx.minimum_cardinality_sequences(words, 5).groupBy("seq", "pos").agg(F.count("*").alias("n"))


def token_types(spark, sf_dir):
    """Documents' tokens, marks apart, by type."""
    tokens = text.split_tokens(F.col("text"), around=r"!-/:-@\[-`{-~")
    t = table(spark, sf_dir, "documents").select(F.explode(text.typed(tokens)).alias("t")).select("t.*")
    return t.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("token")).cast("long").alias("characters"))


def _cells(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return matrix.cells(e, "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)))


_CELLS = "e AS (SELECT vec_id AS i, unnest(generate_series(0, len(embedding) - 1)) AS j, unnest(embedding) AS x FROM embeddings), c AS (SELECT i, j, floor(x::DOUBLE * 1024) AS v FROM e)"


def matrix_sums(spark, sf_dir):
    m = _cells(spark, sf_dir)
    rows, columns = matrix.row_sums(m).select(F.lit("row").alias("side"), F.col("i").alias("at"), "sum"), matrix.column_sums(m).select(F.lit("column").alias("side"), F.col("j").alias("at"), "sum")
    return rows.unionByName(columns)


def matrix_gram(spark, sf_dir):
    """The products of the embeddings' columns with each other, in whole numbers."""
    e = table(spark, sf_dir, "embeddings")
    return matrix.gram(e, F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)), 64)


def _orders_by_part(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.sum("l_quantity").alias("v"))


def matrix_product(spark, sf_dir):
    """Quantities by supplier and line number, times their transpose: a sparse product over line numbers."""
    m = _orders_by_part(spark, sf_dir)
    return matrix.multiply(matrix.transpose(m), m)


def best_evaluation(spark, sf_dir):
    """The flag whose prices a rule of thumb meets best."""
    line = table(spark, sf_dir, "lineitem")
    m = metrics.regression(line, F.col("l_extendedprice"), F.col("l_quantity") * 1500.0, by=["l_returnflag"]).withColumn("mae", F.round("mae", 4))
    return metrics.best(m, "mae", "l_returnflag", highest=False)


def extra_trees(spark, sf_dir):
    p = _points(spark, sf_dir)
    labels = [r[0] for r in p.select("label").distinct().orderBy("label").collect()]
    model = trees.fit(p.withColumn("y", trees.one_hot(F.col("label"), labels)), "vec_id", "v", "y", len(labels), members=10, depth=5, fraction=0.5)
    top = F.array_position("scores", F.array_max("scores")) - 1
    return _accuracy(model.predict(p.drop("x"), "v").withColumn("prediction", F.get(F.array(*map(F.lit, labels)), top.cast("int"))), "prediction")


_TOKENS = r"""t AS (SELECT unnest(regexp_extract_all(text, '[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+')) AS token FROM documents)"""

QUERIES = {
    "index_view": (index_view, "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey, o_orderstatus FROM orders), c AS (SELECT CAST(c_nationkey * 7 AS BIGINT) AS position FROM customer) SELECT position, o_orderkey, o_orderstatus, count(*) AS n FROM c JOIN o USING (position) GROUP BY ALL"),
    "cumulative_shares": (cumulative_shares, "WITH h AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT value, n, sum(n) OVER (ORDER BY value) AS c, sum(n) OVER () AS t FROM h) SELECT value, round((c - n)::DOUBLE / t, 9) AS low, round(c::DOUBLE / t, 9) AS high FROM s"),
    "weighted_bootstrap": (weighted_bootstrap, None),
    "sampled_values": (sampled_values, None),
    "sequence_min_cardinality": (sequence_min_cardinality, "WITH w AS (SELECT DISTINCT conv_id AS seq, turn AS pos, unnest(string_split(text, ' ')) AS name FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), f AS (SELECT * FROM w WHERE name <> ''), k AS (SELECT name FROM f GROUP BY name HAVING count(*) >= 5), m AS (SELECT seq, pos, count(k.name) AS n FROM f LEFT JOIN k USING (name) GROUP BY seq, pos) SELECT seq, pos, n FROM m WHERE seq NOT IN (SELECT seq FROM m WHERE n = 0)"),
    "token_types": (token_types, f"WITH {_TOKENS} SELECT CASE WHEN regexp_full_match(token, '[!-/:-@\\[-`{{-~]') THEN 'PUNCTUATION' ELSE 'WORD' END AS type, count(*) AS n, CAST(sum(length(token)) AS BIGINT) AS characters FROM t GROUP BY 1"),
    "matrix_sums": (matrix_sums, f"WITH {_CELLS} SELECT 'row' AS side, i AS at, sum(v) AS sum FROM c GROUP BY i UNION ALL SELECT 'column', j, sum(v) FROM c GROUP BY j"),
    "matrix_gram": (matrix_gram, f"WITH {_CELLS} SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.i = b.i GROUP BY 1, 2"),
    "matrix_product": (matrix_product, "WITH m AS (SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2"),
    "best_evaluation": (best_evaluation, "SELECT l_returnflag, round(avg(abs(l_extendedprice - l_quantity * 1500.0::DOUBLE)), 4) AS mae FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 1"),
    "extra_trees": (extra_trees, None),
}
