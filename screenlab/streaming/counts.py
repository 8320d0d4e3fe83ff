"""Grouped event counts over tumbling windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """n and sum of value of each event type in each window; events later than ``late`` are not counted."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    w = rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")
