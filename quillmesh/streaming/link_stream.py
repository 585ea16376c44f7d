"""Streaming: late-tolerant keep-first of records by key, and windowed counts of link outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_sightings(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and mean value by event-time window and key, final once the watermark passes the window."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return grouped.select(F.col("window.start").alias("start"), by, "n", "mean")


def link_to_table(stream: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stream rows joined with the stored records of their key."""
    return stream.join(table, key, "left")
