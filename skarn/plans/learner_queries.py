"""Trained models over the tables, seeded, summed up as counts and rounded weights."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from skarn.operators import crf, factorisation, hdbscan, kernel, lime, linear, models, sampling, sequences, sparse_linear
from skarn.plans.feature_queries import table


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return e.select("*", array_to_vector("v").alias("x"))


_NAMES = ["x"]  # the whole vector


def _accuracy(df, prediction):
    return df.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.when(F.col(prediction) == F.col("label"), 1).otherwise(0)).alias("right"))


def logistic_regression(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _accuracy(models.classifier(p, _NAMES, "label", maxIter=20).transform(p), "prediction_label")


def random_forest(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _accuracy(models.classifier(p, _NAMES, "label", "random_forest", numTrees=10).transform(p), "prediction_label")


def linear_sgd(spark, sf_dir):
    p = _points(spark, sf_dir)
    labels = [r[0] for r in p.select("label").distinct().orderBy("label").collect()]
    return _accuracy(linear.fit(p, "v", "label", labels, "log", linear.Optimiser("adam", 0.2), epochs=10).predict(p, "v"), "prediction")


def minibatch_sgd(spark, sf_dir):
    """As ``linear_sgd``, by mini-batches of 32 in five passes over four shards."""
    p = _points(spark, sf_dir)
    labels = [r[0] for r in p.select("label").distinct().orderBy("label").collect()]
    model = linear.fit(p, "v", "label", labels, "log", linear.Optimiser("adagrad", 0.5), epochs=5, batch=32, key="vec_id", shards=4)
    return _accuracy(model.predict(p, "v"), "prediction")


def bagging(spark, sf_dir):
    p = _points(spark, sf_dir)
    out = models.bagging(p, _NAMES, "label", 3, "vec_id", maxDepth=4)(p)
    return _accuracy(out.join(p.select("vec_id", "label"), "vec_id"), "prediction")


def kmeans(spark, sf_dir):
    p = _points(spark, sf_dir)
    return models.kmeans(p, _NAMES, 4).transform(p).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


def gaussian_mixture(spark, sf_dir):
    p = _points(spark, sf_dir)
    return models.gaussian_mixture(p, _NAMES, 3, iterations=10).transform(p).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


def multilabel_relevance(spark, sf_dir):
    """The kinds of a user's even events from how many odd ones of each kind it has."""
    e = table(spark, sf_dir, "events").where("event_type IS NOT NULL")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    odd = [F.sum(F.when((F.col("event_id") % 2 == 1) & (F.col("event_type") == k), 1.0).otherwise(0.0)).alias(f"x{i}") for i, k in enumerate(kinds)]
    s = e.groupBy("user_id").agg(F.array_sort(F.array_compact(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))))).alias("labels"), *odd)
    out = models.independent_multilabel(s, [f"x{i}" for i in range(len(kinds))], "labels", kinds, maxIter=10)(s)
    return out.groupBy(F.array_join(F.array_sort("labels"), ",").alias("truth"), F.array_join("predicted_labels", ",").alias("predicted")).agg(F.count("*").alias("n"))


def factorisation_machine(spark, sf_dir):
    p = _points(spark, sf_dir)
    labels = [r[0] for r in p.select("label").distinct().orderBy("label").collect()]
    return _accuracy(factorisation.fit(p, "v", "label", labels, factors=2, epochs=10).predict(p.drop("x"), "v"), "prediction")


def kernel_svm(spark, sf_dir):
    p = _points(spark, sf_dir)
    labels = [r[0] for r in p.select("label").distinct().orderBy("label").collect()]
    return _accuracy(kernel.fit(p, "v", "label", labels, "rbf", landmarks=64, gamma=0.05, epochs=10).predict(p, "v"), "prediction")


def _role_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role IS NOT NULL").withColumn("x", F.array(F.log1p(F.length("text")) / 10, (F.col("turn") == 0).cast("double")))
    labels = [r[0] for r in c.select("role").distinct().orderBy("role").collect()]
    s = crf.sequences_of(c, "conv_id", ["turn"], "x", "role")
    return s, labels, crf.fit(s, "xs", "labels", labels, epochs=10)


def crf_roles(spark, sf_dir):
    """Roles of conversations' turns, from a constant and the length of the text, by a conditional random field."""
    s, _, model = _role_chain(spark, sf_dir)
    pairs = model.predict(s, "xs").select(F.explode(F.arrays_zip("labels", "prediction")).alias("p"))
    return pairs.groupBy(F.col("p.labels").alias("role"), F.col("p.prediction").alias("prediction")).agg(F.count("*").alias("n"))


def crf_rules(spark, sf_dir):
    """Every conversation's roles if no role follows itself and the first turn's is known: turns, those right, how likely the rules are without being told, and how likely the true roles of the first two turns."""
    s, labels, model = _role_chain(spark, sf_dir)
    s = s.withColumn("rules", F.array(F.slice("labels", 1, 1))).withColumn("chunks", F.array(F.struct(F.lit(0).alias("begin"), F.slice("labels", 1, 2).alias("labels"))))
    found = model.score_chunks(model.predict_within(s, "xs", "rules", [(o, o) for o in labels]), "xs", "chunks")
    right = F.size(F.filter(F.zip_with("labels", "prediction", lambda a, b: a == b), lambda same: same))
    return found.select("conv_id", F.size("labels").alias("turns"), F.when(F.col("prediction").isNotNull(), right).alias("n_right"), F.round("share", 4).alias("share"), F.round(F.get("chunk_scores", F.lit(0)), 4).alias("first_two"))


def density_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hdbscan.hdbscan(e, 5).groupBy("cluster").agg(F.count("*").alias("n"))


def density_predict(spark, sf_dir):
    """Every vector's own cluster and score, and those that the exemplars give it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = hdbscan.fit(e, 5)
    found = model.predict(e).select(F.col("probe").alias("vec_id"), F.col("cluster").alias("predicted"), F.round("outlier_score", 6).alias("predicted_score"))
    return model.assigned.select(F.col("id").alias("vec_id"), "cluster", F.round("outlier_score", 6).alias("outlier_score")).join(found, "vec_id")


def explained_columns(spark, sf_dir):
    """What a discount rule over orders' lines rests on."""
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    rule = lambda t: t.withColumn("y", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    return _weights(spark, lime.explain_columns(rule, line, {"l_returnflag": "R", "l_quantity": 10.0, "l_discount": 0.05}, k=1))


def _weights(spark, found):
    return spark.createDataFrame([(k, round(v, 4)) for k, v in sorted(found.items())], "name string, weight double")


def forward_selection(spark, sf_dir):
    """The one best feature of a price, with its least-squares line."""
    m = sparse_linear.Moments(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return _weights(spark, sparse_linear.forward_selection(m, 1))


def lars_path(spark, sf_dir):
    m = sparse_linear.Moments(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return _weights(spark, sparse_linear.lars(m))


def elastic_net(spark, sf_dir):
    m = sparse_linear.Moments(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return _weights(spark, sparse_linear.elastic_net(m, 100.0, 0.5))


def viterbi(spark, sf_dir):
    """Roles of conversations' turns from the length of the text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.floor(F.length("text") / 100).cast("string").alias("size"))
    out = sequences.viterbi(c, sequences.fit_chain(c, "conv_id", ["turn"], "size", "role"), "conv_id", ["turn"], "size")
    return out.groupBy("role", "prediction").agg(F.count("*").alias("n"))


def bootstrap(spark, sf_dir):
    return sampling.bootstrap(table(spark, sf_dir, "orders"), F.col("o_orderkey"), 1).groupBy("copies").agg(F.count("*").alias("n"))


def cross_validation(spark, sf_dir):
    """Mean absolute error of the mean price, by fold."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")

    def evaluate(train, test):
        return test.crossJoin(F.broadcast(train.agg(F.avg("o_totalprice").alias("m")))).agg(F.round(F.avg(F.abs(F.col("o_totalprice") - F.col("m"))), 4).alias("mae"))  # one row

    return sampling.cross_validate(o, [F.col("o_orderkey")], 3, evaluate)


QUERIES = {
    "logistic_regression": (logistic_regression, None),
    "random_forest": (random_forest, None),
    "linear_sgd": (linear_sgd, None),
    "minibatch_sgd": (minibatch_sgd, None),
    "bagging": (bagging, None),
    "kmeans": (kmeans, None),
    "gaussian_mixture": (gaussian_mixture, None),
    "multilabel_relevance": (multilabel_relevance, None),
    "factorisation_machine": (factorisation_machine, None),
    "kernel_svm": (kernel_svm, None),
    "crf_roles": (crf_roles, None),
    "crf_rules": (crf_rules, None),
    "density_clusters": (density_clusters, None),
    "density_predict": (density_predict, None),
    "explained_columns": (explained_columns, None),
    "forward_selection": (forward_selection, "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS f, corr(l_extendedprice, {c}) AS r, regr_slope(l_extendedprice, {c}) AS s, regr_intercept(l_extendedprice, {c}) AS i FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + "), b AS (SELECT * FROM c ORDER BY abs(r) DESC LIMIT 1) SELECT f AS name, round(s, 4) AS weight FROM b UNION ALL SELECT 'bias', round(i, 4) FROM b"),
    "lars_path": (lars_path, None),
    "elastic_net": (elastic_net, None),
    "viterbi": (viterbi, None),
    "bootstrap": (bootstrap, None),
    "cross_validation": (cross_validation, "WITH r AS (SELECT o_totalprice AS v, ntile(3) OVER (ORDER BY o_orderkey) - 1 AS f FROM orders), m AS (SELECT f, (sum(sum(v)) OVER () - sum(v)) / (sum(count(*)) OVER () - count(*)) AS m FROM r GROUP BY f) SELECT round(avg(abs(v - m)), 4) AS mae, CAST(f AS INTEGER) AS fold FROM r JOIN m USING (f) GROUP BY f"),
}
