"""Streams: event windows and online evaluation; state is counts by window or by cell, never rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """(start, by..., n, total of value) by fixed windows; with ``late`` a watermark bounds the state of a stream."""
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, by: list[str], late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """(key, start, n) of runs of events no more than ``gap`` apart."""
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def online_confusion(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Running confusion counts of a stream of predictions (complete or update mode): what online evaluation needs, bounded by labels."""
    return predictions.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def stream_of(spark, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives its result (for small results, such as tests)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
