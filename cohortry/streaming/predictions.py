"""Confusion cells kept up to date over a stream of predictions or events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and key; rows later than ``late`` are dropped on a stream."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def running_cells(predictions: DataFrame, keys: list[str] = []) -> DataFrame:
    """Confusion cells of all rows so far: the state is one row per cell, so it does not grow with the stream."""
    return predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete", seconds: int = 60) -> DataFrame:
    """All that is there now, through a memory table: for tests and small aggregates."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(seconds)
    return stream.sparkSession.table(name)
