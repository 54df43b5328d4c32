"""Exact kernel machines over all embeddings, with the SQL of their passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import dual_kernel
from skarn.plans.feature_queries import table

PASSES, SCALE = 2, 8


def kernel_exact(spark, sf_dir):
    """Labels of all vectors (components as whole eighths) by a quadratic kernel, and the rows' dual weights."""
    x = F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")).cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), x.alias("v"))
    outputs = [r[0] for r in rows.where("label IS NOT NULL").select("label").distinct().orderBy("label").collect()]
    order = lambda epoch: [F.md5(F.concat(F.lit(f"{epoch}:"), F.col("key").cast("string")))]
    model = dual_kernel.fit(rows, "v", "label", outputs, "vec_id", "polynomial", PASSES, order=order, degree=2)
    return model.predict(rows, "v", "vec_id").join(model.support.select(F.col("key").alias("vec_id"), "alpha"), "vec_id", "left").select("vec_id", "prediction", F.coalesce("alpha", F.lit(0.0)).alias("alpha"))


def _sql() -> str:
    """One row after the other: ``a`` holds the dual weights by place, ``g`` the kernel values of a row with all."""
    scores = "list_transform((SELECT list(label ORDER BY label) FROM l), lambda o: list_sum(list_transform(range(1, len({a}) + 1), lambda j: CASE WHEN g.labels[j] = o THEN {a}[j] * g.k[j] ELSE 0.0 END)){less})"
    step = scores.format(a="s.a", less=" - CASE WHEN o = g.label THEN 1.0 ELSE 0.0 END")
    last = scores.format(a="f.a", less="")
    names = "(SELECT list(label ORDER BY label) FROM l)"
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT vec_id, CAST(label AS VARCHAR) AS label, list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS x, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS MATERIALIZED (SELECT DISTINCT label FROM p),
g AS MATERIALIZED (SELECT a.i, any_value(a.vec_id) AS vec_id, any_value(a.label) AS label, list(b.label ORDER BY b.i) AS labels, list(pow(list_inner_product(a.x, b.x) + 1, 2) ORDER BY b.i) AS k FROM p a CROSS JOIN p b GROUP BY a.i),
o AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY e, md5(e || ':' || vec_id), vec_id) AS t FROM p CROSS JOIN range({PASSES}) r(e)),
s AS (SELECT CAST(0 AS BIGINT) AS t, list_transform(range((SELECT count(*) FROM p)), lambda j: 0.0::DOUBLE) AS a
UNION ALL SELECT t, CASE WHEN {names}[list_position(z, list_max(z))] = label THEN a ELSE list_transform(a, lambda v, j: v + CASE WHEN j = i THEN 1.0 ELSE 0.0 END) END
FROM (SELECT o.t, o.i, g.label, s.a, {step} AS z FROM s JOIN o ON o.t = s.t + 1 JOIN g USING (i))),
f AS (SELECT a FROM s ORDER BY t DESC LIMIT 1)
SELECT vec_id, {names}[list_position(z, list_max(z))] AS prediction, alpha FROM (SELECT g.vec_id, f.a[g.i] AS alpha, {last} AS z FROM g CROSS JOIN f)"""


QUERIES = {"kernel_exact": (kernel_exact, _sql())}
