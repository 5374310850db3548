"""Counts by key and day kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """events with ts and user_id, as a stream or a table; events later than late behind the newest are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("day.start").alias("day"), "user_id", "n")
