"""Streaming aggregates that Spark keeps bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_by_hour(signals: DataFrame, late: str = "1 day") -> DataFrame:
    """Collected signals per hour and source; an hour is final once the watermark has passed it."""
    return (
        signals.withWatermark("collected_at", late)
        .groupBy(F.window("collected_at", "1 hour").alias("w"), "source")
        .agg(F.count("*").alias("signals"))
        .select(F.col("w.start").alias("hour"), "source", "signals")
    )


def first_versions(signals: DataFrame, window: str = "7 days") -> DataFrame:
    """Each id and hash once within the window; what is evicted may pass again and is harmless."""
    return signals.withWatermark("collected_at", window).dropDuplicatesWithinWatermark(["id", "event_hash"])
