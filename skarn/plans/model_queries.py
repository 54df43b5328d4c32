"""Text, vectors, neighbours, closed-form models, sequences and windows over the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from skarn.functions import vectors as vx
from skarn.operators import baselines as bl
from skarn.operators import pairwise
from skarn.operators import text as tx
from skarn.operators.neighbours import core_distances, k_nearest, knn_vote
from skarn.plans.feature_queries import table
from skarn.streaming import online


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", spread=True).select(F.col("doc_id").alias("id"), "text", "lang", "source")


_TOK = "t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS toks FROM documents)"


def tokenise_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.size(tx.whitespace_tokens(F.col("text"))).cast("long").alias("n_tokens"))


def ngram_counts(spark, sf_dir):
    t = tx.term_features(table(spark, sf_dir, "conversations").select(F.monotonically_increasing_id().alias("id"), "text"), "id", tx.whitespace_tokens(F.col("text")), upto=2)
    return t.groupBy("name").agg(F.sum("value").cast("long").alias("n")).where("n >= 3")


def term_counts(spark, sf_dir):
    t = tx.term_features(_docs(spark, sf_dir), "id", tx.whitespace_tokens(F.lower("text")))
    return t.groupBy("id").agg(F.count("*").alias("n_terms"), F.sum("value").cast("long").alias("n_tokens"), F.max("value").cast("long").alias("most"))


def unique_terms(spark, sf_dir):
    t = tx.term_features(_docs(spark, sf_dir), "id", tx.whitespace_tokens(F.lower("text")), unique=True)
    return t.groupBy("name").agg(F.count("*").alias("df")).where("df >= 20")


def tf_idf(spark, sf_dir):
    d = _docs(spark, sf_dir)
    t = tx.tf_idf(tx.term_features(d, "id", tx.whitespace_tokens(F.col("text"))), d.count())
    return t.groupBy("id").agg(F.round(F.max("value"), 5).alias("top"), F.round(F.sum("value"), 4).alias("total"))


def preprocess(spark, sf_dir):
    """Case and pattern preprocessing: characters left."""
    text = tx.regex_replace(tx.case(F.col("text")), [("[0-9]+", "#"), ("[.,]", "")])
    return _docs(spark, sf_dir).select("id", F.length(text).cast("long").alias("chars"), F.length(F.regexp_replace(text, "[^#]", "")).cast("long").alias("numbers"))


def hashed_terms(spark, sf_dir):
    t = tx.term_features(_docs(spark, sf_dir), "id", tx.whitespace_tokens(F.col("text")), hash_to=64)
    return t.select("id", F.col("name").cast("int").alias("bucket"), F.col("value").cast("long").alias("n"))


def _murmur_sql(name: str, seed: int) -> str:
    """SQL of the 32-bit Murmur3 of a string's UTF-8, as an unsigned number."""
    low = "% 4294967296"
    word = lambda at, n: "('0x' || " + " || ".join(f"substr(x, {at} + {2 * i}, 2)" for i in reversed(range(n))) + ")::UBIGINT"
    mixed = lambda k: f"((((({k}) * 3432918353 {low}) << 15) {low} | ((({k}) * 3432918353 {low}) >> 17)) * 461845907 {low})"
    turned = lambda h: f"((({h} << 13) {low} | ({h} >> 19)) * 5 + 3864292196) {low}"
    body = f"list_reduce(list_prepend({seed}::UBIGINT, list_transform(range(0, n // 4), lambda j: {mixed(word('8 * j + 1', 4))})), lambda h, k: {turned('xor(h, k)')})"
    tail = "CASE n % 4 " + " ".join(f"WHEN {r} THEN {mixed(word('8 * (n // 4) + 1', r))}" for r in (1, 2, 3)) + " ELSE 0 END"
    return f"""m0 AS (SELECT DISTINCT {name} AS name FROM w), m1 AS (SELECT name, hex(encode(name)) AS x, octet_length(encode(name)) AS n FROM m0),
m2 AS (SELECT name, xor(xor({body}, ({tail})::UBIGINT), n::UBIGINT) AS h FROM m1), m3 AS (SELECT name, xor(h, h >> 16) * 2246822507 {low} AS h FROM m2),
m4 AS (SELECT name, xor(h, h >> 13) * 3266489909 {low} AS h FROM m3), hashes AS (SELECT name, xor(h, h >> 16) AS h FROM m4)"""


def tokenise_shape(spark, sf_dir):
    """Tokens of letters and of digits."""
    t = F.transform(tx.shape_tokens(F.col("text")), lambda t: F.regexp_extract(t, r"^(?:[\p{Lu}\p{Ll}]+|[0-9]+)$", 0))
    return _docs(spark, sf_dir).select("id", F.filter(t, lambda t: t != "").alias("t")).select("id", F.size("t").cast("long").alias("n"), F.length(F.array_join("t", "")).cast("long").alias("chars"), F.array_max(F.transform("t", F.length)).alias("longest"))


def tokenise_universal(spark, sf_dir):
    t = tx.universal_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("id", t.alias("t")).select("id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_max(F.transform("t", F.length)).alias("longest"))


def _distances(x, y):
    """L1, L2 and cosine distances; the cosine of a vector without length is 0."""
    l1, square, dot = pairwise.sums(x, y, lambda a, b: np.abs(a - b), lambda a, b: (a - b) ** 2, lambda a, b: a * b)
    norms = np.sqrt(pairwise.squares(x))[:, None] * np.sqrt(pairwise.squares(y))[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(dot == 0, 0.0, dot / norms)
    return [pairwise.rounded(m, 6) for m in (l1, np.sqrt(square), 1 - cosine)]


def distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return pairwise.pairs(e.where("vec_id % 50 = 0"), e, ["l1", "l2", "cosine"], _distances)


def _kernels(x, y):
    """Linear, polynomial, radial and sigmoid kernels."""
    dot, square = pairwise.sums(x, y, lambda a, b: a * b, lambda a, b: (a - b) ** 2)
    return [pairwise.rounded(dot, 6), pairwise.rounded((0.5 * dot + 1) ** 2, 5), pairwise.rounded(np.exp(-0.1 * square), 6), pairwise.rounded(np.tanh(0.1 * dot), 6)]


def kernels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return pairwise.pairs(e.where("vec_id % 50 = 0"), e, ["linear", "poly", "rbf", "sigmoid"], _kernels)


_PAIR = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.v AS x, b.v AS y FROM e a CROSS JOIN e b WHERE a.vec_id % 50 = 0)"


def knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = k_nearest(e.where("vec_id % 25 = 0"), e, 5)
    return near.select("probe", "rank", "neighbour", F.round("distance", 6).alias("distance"))


def knn_classify(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = k_nearest(e.where("vec_id % 25 = 0"), e.where("vec_id % 25 <> 0"), 7)
    return knn_vote(near, e, "vec_id", "label").select("probe", "prediction", F.col("votes").cast("long").alias("votes"))


def core_distance(spark, sf_dir):
    return core_distances(table(spark, sf_dir, "embeddings"), 4).select("id", F.round("core_distance", 6).alias("core_distance"))


_KNN = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id AS probe, b.vec_id AS neighbour, b.label, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM e a CROSS JOIN e b WHERE {0}), r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY distance, neighbour) AS rank FROM d)"


def kmeans_step(spark, sf_dir):
    """One Lloyd step from the labels' means: how many points each centroid gets."""
    from skarn.operators.models import assign, centroids

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    near = assign(e, centroids(e, "label", "v"), "vec_id", "v")
    return near.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"))


def dummy_most_frequent(spark, sf_dir):
    return bl.dummy_classifier(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type").groupBy("prediction").agg(F.count("*").alias("n"))


def dummy_regressors(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = bl.dummy_regressor(o, "o_totalprice").select(F.lit("mean").alias("kind"), F.round("value", 4).alias("value"))
    for name, kind, q in (("median", "MEDIAN", 0.5), ("q25", "QUARTILE", 0.25), ("q75", "QUARTILE", 0.75)):
        out = out.unionByName(bl.dummy_regressor(o, "o_totalprice", kind, q).select(F.lit(name).alias("kind"), F.round("value", 4).alias("value")))
    return out


def _mnb(spark, sf_dir):
    terms = tx.term_features(_docs(spark, sf_dir), "id", tx.whitespace_tokens(F.lower(F.col("text"))), keep=("lang",)).persist()  # for the model and for the scores
    return terms, bl.mnb_fit(terms, label="lang")


def mnb_model(spark, sf_dir):
    _, (seen, unseen) = _mnb(spark, sf_dir)
    return seen.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("logp"), 6).alias("top")).join(unseen, "label").select("label", "n", "top", F.round("unseen", 6).alias("unseen"))


def mnb_predict(spark, sf_dir):
    terms, model = _mnb(spark, sf_dir)
    return bl.best_label(bl.mnb_score(terms, model))


_MNB = """w AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS t FROM documents),
v AS (SELECT count(DISTINCT t) AS size FROM w), m AS (SELECT lang, t, count(*) AS n FROM w GROUP BY 1, 2), g AS (SELECT lang, sum(n) AS total FROM m GROUP BY 1),
s AS (SELECT lang, t, ln((n + 1.0::DOUBLE) / (total + size)) AS logp FROM m JOIN g USING (lang) CROSS JOIN v), u AS (SELECT lang, ln(1.0::DOUBLE / (total + size)) AS unseen FROM g CROSS JOIN v)"""


def vote_combine(spark, sf_dir):
    return bl.vote(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", "prediction", F.col("votes").cast("long").alias("votes"))


def average_combine(spark, sf_dir):
    return bl.average(table(spark, sf_dir, "events"), "user_id", "value").select("user_id", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


def preceding_labels(spark, sf_dir):
    """Each event with the two types before it, by user: what a sequence model is given."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p1, p2 = F.lag("event_type", 1).over(w), F.lag("event_type", 2).over(w)
    return e.select("event_id", p1.alias("p1"), p2.alias("p2"), F.concat_ws("/", p2, p1).alias("bigram"))


def label_transitions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy(F.coalesce("before", F.lit("START")).alias("before"), "role").agg(F.count("*").alias("n"))


def change_points(spark, sf_dir):
    """Runs of one type in each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("new", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("long"))
    return e.groupBy("user_id").agg(F.sum("new").alias("n_runs"), F.count("*").alias("n"))


def cumulative_sum(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


def tumbling(spark, sf_dir):
    t = online.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])
    return t.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(spark, sf_dir):
    return online.sliding(table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", ["event_type"]).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


def sessions(spark, sf_dir):
    return online.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", "user_id").select("user_id", F.unix_timestamp("start").alias("start"), "n")


def set_operations(spark, sf_dir):
    """Label sets of users: sizes of their union and intersection by parity of the event."""
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("b"))
    return s.select("user_id", F.size(F.array_union("a", "b")).cast("long").alias("either"), F.size(F.array_intersect("a", "b")).cast("long").alias("both"), F.size(vx.difference(F.col("a"), F.col("b"))).cast("long").alias("only_a"))


def softmax_scores(spark, sf_dir):
    from skarn.functions.scalars import softmax

    p = table(spark, sf_dir, "part").select("p_partkey", softmax(F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0, F.lit(1.0))).alias("s"))
    return p.select("p_partkey", *[F.round(F.get("s", F.lit(i)), 6).alias(f"s{i}") for i in range(3)])


QUERIES = {
    "tokenise_whitespace": (tokenise_whitespace, f"WITH {_TOK} SELECT doc_id AS id, CAST(len(toks) AS BIGINT) AS n_tokens FROM t"),
    "ngram_counts": (ngram_counts, "WITH t AS (SELECT list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS k FROM conversations), g AS (SELECT 'n-1=' || unnest(k) AS name FROM t UNION ALL SELECT 'n-2=' || k[i] || '/' || k[i + 1] FROM (SELECT k, unnest(generate_series(1, len(k) - 1)) AS i FROM t)) SELECT name, count(*) AS n FROM g GROUP BY name HAVING count(*) >= 3"),
    "term_counts": (term_counts, "WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS t FROM documents), c AS (SELECT id, t, count(*) AS n FROM w GROUP BY 1, 2) SELECT id, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS most FROM c GROUP BY 1"),
    "unique_terms": (unique_terms, "WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS t FROM documents) SELECT 'n-1=' || t AS name, count(*) AS df FROM w GROUP BY 1 HAVING count(*) >= 20"),
    "tf_idf": (tf_idf, "WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS t FROM documents), c AS (SELECT id, t, count(*) AS tf FROM w GROUP BY 1, 2), f AS (SELECT t, count(*) AS df FROM c GROUP BY 1), s AS (SELECT id, ln((SELECT count(*) FROM documents)::DOUBLE / df) * (1 + ln(tf)) AS v FROM c JOIN f USING (t)) SELECT id, round(max(v), 5) AS top, round(sum(v), 4) AS total FROM s GROUP BY 1"),
    "preprocess": (preprocess, "WITH p AS (SELECT doc_id AS id, regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[.,]', '', 'g') AS t FROM documents) SELECT id, length(t) AS chars, length(regexp_replace(t, '[^#]', '', 'g')) AS numbers FROM p"),
    "hashed_terms": (hashed_terms, f"WITH {_TOK}, w AS (SELECT doc_id, 'n-1=' || unnest(toks) AS name FROM t), {_murmur_sql('name', tx.HASH_SEED)} SELECT doc_id AS id, CAST((h >> 1) % 64 AS INTEGER) AS bucket, count(*) AS n FROM w JOIN hashes USING (name) GROUP BY 1, 2"),
    "tokenise_shape": (tokenise_shape, r"WITH t AS (SELECT doc_id, regexp_extract_all(text, '\p{Lu}+\p{Ll}*|\p{Ll}+|[0-9]+') AS t FROM documents) SELECT doc_id AS id, CAST(len(t) AS BIGINT) AS n, CAST(len(array_to_string(t, '')) AS BIGINT) AS chars, CAST(list_max(list_transform(t, lambda x: len(x))) AS INTEGER) AS longest FROM t"),
    "tokenise_universal": (tokenise_universal, r"WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ÒÓ', '  '), '[\p{L}\p{Nd}]{1,256}') AS t FROM documents) SELECT doc_id AS id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, CAST(list_max(list_transform(t, lambda x: len(x))) AS INTEGER) AS longest FROM t"),
    "distances": (distances, f"WITH {_PAIR} SELECT a, b, round(list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 6) AS l1, round(sqrt(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS l2, round(1 - list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))), 6) + 0.0 AS cosine FROM p"),
    "kernels": (kernels, f"WITH {_PAIR}, k AS (SELECT a, b, list_inner_product(x, y) AS d, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS q FROM p) SELECT a, b, round(d, 6) AS linear, round(pow(0.5 * d + 1, 2), 5) AS poly, round(exp(-0.1 * q), 6) AS rbf, round((exp(0.2 * d) - 1) / (exp(0.2 * d) + 1), 6) + 0.0 AS sigmoid FROM k"),
    "knn": (knn, f"WITH {_KNN.format('a.vec_id % 25 = 0')} SELECT probe, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) AS distance FROM r WHERE rank <= 5"),
    "knn_classify": (knn_classify, f"WITH {_KNN.format('a.vec_id % 25 = 0 AND b.vec_id % 25 <> 0')}, v AS (SELECT probe, label, count(*) AS votes FROM r WHERE rank <= 7 GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY votes DESC, label) AS k FROM v) SELECT probe, label AS prediction, votes FROM t WHERE k = 1"),
    "core_distance": (core_distance, f"WITH {_KNN.format('TRUE')} SELECT probe AS id, round(max(distance), 6) AS core_distance FROM r WHERE rank <= 4 GROUP BY 1"),
    "kmeans_step": (kmeans_step, """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT label, i, avg(v[i]) AS x FROM e CROSS JOIN generate_series(1, 64) g(i) GROUP BY 1, 2), c AS (SELECT label AS cluster, list(x ORDER BY i) AS c FROM m GROUP BY 1),
      d AS (SELECT vec_id, cluster, sqrt(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM e CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 12), cluster) AS k FROM d)
      SELECT cluster, count(*) AS n, round(avg(distance), 6) AS mean_distance FROM r WHERE k = 1 GROUP BY 1"""),
    "dummy_most_frequent": (dummy_most_frequent, "SELECT (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) AS prediction, count(*) AS n FROM events"),
    "dummy_regressors": (dummy_regressors, "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT 'mean' AS kind, round(avg(v), 4) AS value FROM r UNION ALL SELECT 'median', round(v, 4) FROM r WHERE i = n // 2 UNION ALL SELECT 'q25', round(v, 4) FROM r WHERE i = CAST(floor(n * 0.25) AS BIGINT) UNION ALL SELECT 'q75', round(v, 4) FROM r WHERE i = CAST(floor(n * 0.75) AS BIGINT)"),
    "mnb_model": (mnb_model, f"WITH {_MNB} SELECT lang AS label, count(*) AS n, round(max(logp), 6) AS top, round(any_value(unseen), 6) AS unseen FROM s JOIN u USING (lang) GROUP BY 1"),
    "mnb_predict": (mnb_predict, f"WITH {_MNB}, k AS (SELECT w.doc_id, u.lang, sum(coalesce(s.logp, u.unseen)) AS score FROM w CROSS JOIN u LEFT JOIN s ON s.lang = u.lang AND s.t = w.t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, lang) AS p FROM k) SELECT doc_id AS id, lang AS prediction FROM r WHERE p = 1"),
    "vote_combine": (vote_combine, "WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM v) SELECT user_id, event_type AS prediction, n AS votes FROM r WHERE k = 1"),
    "average_combine": (average_combine, "SELECT user_id, round(avg(value), 6) AS mean, round(greatest(avg(value * value) - avg(value) * avg(value), 0), 4) AS variance FROM events GROUP BY 1"),
    "preceding_labels": (preceding_labels, "SELECT event_id, lag(event_type, 1) OVER w AS p1, lag(event_type, 2) OVER w AS p2, concat_ws('/', lag(event_type, 2) OVER w, lag(event_type, 1) OVER w) AS bigram FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "label_transitions": (label_transitions, "WITH c AS (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT coalesce(b, 'START') AS before, role, count(*) AS n FROM c GROUP BY 1, 2"),
    "change_points": (change_points, "WITH c AS (SELECT user_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS n FROM events) SELECT user_id, CAST(sum(n) AS BIGINT) AS n_runs, count(*) AS n FROM c GROUP BY 1"),
    "cumulative_sum": (cumulative_sum, "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders"),
    "tumbling_windows": (tumbling, "SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "sliding_windows": (sliding, "WITH b AS (SELECT epoch(time_bucket(INTERVAL '30 minutes', ts)) AS s, event_type FROM events), w AS (SELECT s, event_type FROM b UNION ALL SELECT s - 1800, event_type FROM b) SELECT CAST(s AS BIGINT) AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2"),
    "session_windows": (sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k"),
    "set_operations": (set_operations, "WITH s AS (SELECT user_id, event_type, max(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END) AS b FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS either, CAST(sum(a * b) AS BIGINT) AS \"both\", CAST(sum(a * (1 - b)) AS BIGINT) AS only_a FROM s GROUP BY 1"),
    "softmax": (softmax_scores, "WITH x AS (SELECT p_partkey, exp(p_size / 10.0::DOUBLE) AS a, exp(p_retailprice / 1000.0::DOUBLE) AS b, exp(1.0::DOUBLE) AS c FROM part) SELECT p_partkey, round(a / (a + b + c), 6) AS s0, round(b / (a + b + c), 6) AS s1, round(c / (a + b + c), 6) AS s2 FROM x"),
}
