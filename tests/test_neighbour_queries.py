"""The queries for neighbours write and shuffle no more than points and results, however many blocks meet."""

import numpy as np
import pytest

from skarn.operators import neighbours
from skarn.plans import model_queries


@pytest.mark.parametrize("name", ["knn", "knn_classify"])
def test_no_shuffle_of_pairs(spark, monkeypatch, tmp_path, name):
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    r = np.random.default_rng(6)
    rows = [(i, [float(c) for c in p], i % 3) for i, p in enumerate(r.normal(0, 1, (1500, 6)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = getattr(model_queries, name)(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "right_v" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
    assert found.select("probe").distinct().count() == 60
