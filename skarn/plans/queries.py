"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

from skarn.plans import feature_queries, kernel_queries, learner_queries, metric_queries, mixture_queries, model_queries, sample_queries, stream_queries, tree_queries, wide_queries

_ALL = feature_queries.QUERIES | metric_queries.QUERIES | model_queries.QUERIES | learner_queries.QUERIES | sample_queries.QUERIES | wide_queries.QUERIES | mixture_queries.QUERIES | tree_queries.QUERIES | stream_queries.QUERIES | kernel_queries.QUERIES


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def checked_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
