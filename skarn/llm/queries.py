"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.clustering import cluster
from skarn.llm.decontamination import leaked_items
from skarn.llm.langid import identify, learn
from skarn.llm.license_scan import scan_licenses
from skarn.llm.line_dedup import dedup_lines
from skarn.llm.packing import pack_documents
from skarn.llm.quality import classify
from skarn.llm.secret_scan import scan_secrets
from skarn.llm.simhash import near_duplicates
from skarn.llm.substring_dedup import dedup_substrings
from skarn.llm.token_counts import count_tokens
from skarn.llm.topk import top_k
from skarn.llm.whitening import whiten

#: Where the tokenizers' files lie; a parameter of the operators.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packing(spark, sf_dir):
    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), with_ids=False)


def line_dedup(spark, sf_dir):
    out = dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), n_col="n_removed")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select("doc_id", lines.cast("long").alias("n_lines"), "n_removed", F.sha2("text", 256).alias("text_sha256"))


def simhash(spark, sf_dir):
    return near_duplicates(_documents(spark, sf_dir))


def secrets(spark, sf_dir):
    return scan_secrets(_documents(spark, sf_dir))


def pivots(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)


def licenses(spark, sf_dir):
    return scan_licenses(_documents(spark, sf_dir))


def token_counts(spark, sf_dir):
    return count_tokens(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def languages(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    # a null id has no remainder: it isn't held out, nor learned from
    prototypes = learn(docs.where(~held_out))
    return identify(docs, prototypes).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def decontamination(spark, sf_dir):
    return leaked_items(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def substrings(spark, sf_dir):
    return dedup_substrings(_documents(spark, sf_dir)).drop("kept")


def quality(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    # trusted are the rows that may be learnt from and whose labels are all 1; a label of 0 is never read as one
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out & F.col("quality").isNotNull())
    positives = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    out = classify(_documents(spark, sf_dir), positives, threshold=0.3)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def whitened(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def clusters(spark, sf_dir):
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("n_compared")


def queries() -> dict:
    return {
        "op1_packing": packing,
        "op2_line_dedup": line_dedup,
        "op3_simhash": simhash,
        "op4_secrets": secrets,
        "op5_pivot_topk": pivots,
        "op6_licenses": licenses,
        "op7_token_counts": token_counts,
        "op8_language_id": languages,
        "op9_decontamination": decontamination,
        "op10_substring_dedup": substrings,
        "op11_quality": quality,
        "op12_whitening": whitened,
        "op13_annulus": clusters,
    }


def checked_sql() -> dict[str, str]:
    return {"op5_pivot_topk": TOP_K, "op10_substring_dedup": SUBSTRINGS, "op13_annulus": _clusters_sql(8, 10)}


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT g.doc_id, unnest(generate_series(g.i, g.i + 12)) AS p FROM g JOIN m USING (k) WHERE g.doc_id > m.first),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone.ps IS NULL THEN d.w ELSE list_filter(d.w, lambda x, i: NOT list_contains(gone.ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


def _clusters_sql(k: int, rounds: int) -> str:
    """The rounds written out one after the other."""
    parts = ["""v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""", f"""c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS c, v AS m FROM v
  QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v, min(s) AS distance, arg_min(c, s * {k} + c) AS c FROM (
    SELECT v.n, v.vec_id, v.v, c.c, CAST(list_sum(list_transform(list_zip(v.v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS s FROM v, c{i} c)
  GROUP BY n)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.m, o.m) AS m FROM c{i} o LEFT JOIN (
    SELECT c, list(x ORDER BY j) AS m FROM (
      SELECT c, j, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM (SELECT c, unnest(v) AS x, unnest(generate_series(1, 64)) AS j FROM a{i}) GROUP BY c, j)
    GROUP BY c) m USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.c AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)
"""
