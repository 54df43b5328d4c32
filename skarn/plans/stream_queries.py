"""A linear model that learns from a stream of all lines of orders, with the SQL of its steps."""

from __future__ import annotations

from skarn.operators.linear import Optimiser
from skarn.operators.scratch import Scratch
from skarn.plans.feature_queries import table
from skarn.streaming.training import ModelStore, StreamedLinear

FEATURES = ["l_quantity / 50", "l_discount * 10", "l_tax * 10"]
TARGET = "l_extendedprice / 100000"
BATCHES, EPOCHS, RATE = 3, 2, 0.5


def streamed_linear(spark, sf_dir):
    """After each batch: rows learnt from, steps, the loss before the batch, weights.  The stream ends after each batch and goes on from its checkpoint."""
    scratch = Scratch(spark)
    source, checkpoint = f"{scratch.path}/stream", f"{scratch.path}/checkpoint"
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber", f"array({', '.join(FEATURES)}) AS x", f"array({TARGET}) AS y")
    learner = StreamedLinear(ModelStore(spark, f"{scratch.path}/model"), "x", "y", ["price"], len(FEATURES), "squared", Optimiser("sgd", RATE), EPOCHS)
    for k in range(BATCHES):
        lines.where(f"l_linenumber % {BATCHES} = {k}").write.mode("append").parquet(source)
        learner.start(spark.readStream.schema(lines.schema).parquet(source), checkpoint, available_now=True).awaitTermination()
    found = [learner.store.read(v) for v in learner.store.versions()]
    scratch.clear()
    rows = [(v.number, v.rows, v.steps, round(v.loss, 6), *[round(float(w), 6) for w in v.weights]) for v in found]
    return spark.createDataFrame(rows, "version long, rows long, steps long, loss double, quantity double, discount double, tax double, bias double")


def _sql() -> str:
    x = [f"CAST({f} AS DOUBLE)" for f in FEATURES]
    parts = [f"r AS MATERIALIZED (SELECT l_linenumber % {BATCHES} AS k, {', '.join(f'{e} AS x{i}' for i, e in enumerate(x))}, CAST({TARGET} AS DOUBLE) AS y FROM lineitem)", "w0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3)"]
    error = "(b0 * x0 + b1 * x1 + b2 * x2 + b3 - y)"
    out, t = [], 0
    for k in range(BATCHES):
        parts.append(f"l{k} AS MATERIALIZED (SELECT avg({error} ** 2) / 2 AS loss FROM r, w{t} WHERE k = {k})")
        for _ in range(EPOCHS):
            steps = ", ".join(f"any_value(b{i}) - {RATE} * avg({error}{f' * x{i}' if i < 3 else ''}) AS b{i}" for i in range(4))
            parts.append(f"w{t + 1} AS MATERIALIZED (SELECT {steps} FROM r, w{t} WHERE k = {k})")
            t += 1
        out.append(f"SELECT {k} AS version, (SELECT count(*) FROM r WHERE k <= {k}) AS n_rows, {t} AS steps, l.loss, w.b0, w.b1, w.b2, w.b3 FROM l{k} l, w{t} w")
    return f"WITH {', '.join(parts)} SELECT CAST(version AS BIGINT) AS version, CAST(n_rows AS BIGINT) AS \"rows\", CAST(steps AS BIGINT) AS steps, round(loss, 6) AS loss, round(b0, 6) AS quantity, round(b1, 6) AS discount, round(b2, 6) AS tax, round(b3, 6) AS bias FROM ({' UNION ALL '.join(out)})"


QUERIES = {"streamed_linear": (streamed_linear, _sql())}
