"""Delivery rows: one per sink and event, reset whenever the event changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.plans import fan_out
from rillflow.schemas import DELIVERIES

COLUMNS = tuple(DELIVERIES.fieldNames())


def pending_row(updated_at: Column) -> list[Column]:
    """A fresh delivery row of the current ``sink_key`` and ``event_id``."""
    return [
        F.col("sink_key"),
        F.col("event_id"),
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("timestamp").alias("next_attempt_at"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(None).cast("timestamp").alias("delivered_at"),
        updated_at.alias("updated_at"),
    ]


def enabled(sinks: DataFrame) -> DataFrame:
    return sinks.filter("enabled").select("sink_key")


def queued(changes: DataFrame, sinks: DataFrame, seq: str = "seq") -> DataFrame:
    """The reset rows of a batch: the last change of each event, for every enabled sink."""
    last = (
        changes.filter(F.col("change") != "unchanged")
        .groupBy(F.col("id").alias("event_id"))
        .agg(F.max_by("collected_at", seq).alias("at"))
    )
    return fan_out(last, enabled(sinks), "sink_key").select(*pending_row(F.col("at")))


def enqueue(changes: DataFrame, sinks: DataFrame, deliveries: DataFrame, seq: str = "seq") -> DataFrame:
    """Delivery table after a batch: every changed event is pending again for every enabled sink."""
    fresh = queued(changes, sinks, seq)
    kept = deliveries.select(*COLUMNS).join(
        fresh.select("sink_key", "event_id"), ["sink_key", "event_id"], "left_anti"
    )
    return kept.select(*COLUMNS).unionByName(fresh)


def register_sinks(sinks: DataFrame, names: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Enable the named sinks; also returns ``(sink_key, is_new)``."""
    asked = names.select("sink_key").filter(F.trim("sink_key") != "").distinct()
    marked = asked.withColumn("_asked", F.lit(True))
    joined = sinks.join(marked, "sink_key", "full_outer")
    wanted = F.coalesce(F.col("_asked"), F.lit(False))
    table = joined.select(
        "sink_key",
        F.when(wanted, F.lit(True)).otherwise(F.col("enabled")).alias("enabled"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(wanted, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    is_new = joined.filter("_asked").select("sink_key", F.col("created_at").isNull().alias("is_new"))
    return table, is_new


def backfill(signals: DataFrame, names: DataFrame, deliveries: DataFrame, now: Column) -> DataFrame:
    """Delivery rows that queue stored events for the named sinks; existing rows stay untouched."""
    wanted = fan_out(signals.select(F.col("id").alias("event_id")), names, "sink_key")
    return wanted.join(
        deliveries.select("sink_key", "event_id"), ["sink_key", "event_id"], "left_anti"
    ).select(*pending_row(now))


def disable_sinks(sinks: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """Disabled sinks get no new rows; the rows they have stay."""
    off = names.select("sink_key").distinct().withColumn("_off", F.lit(True))
    hit = F.coalesce(F.col("_off"), F.lit(False))
    return sinks.join(off, "sink_key", "left").select(
        "sink_key",
        (F.col("enabled") & ~hit).alias("enabled"),
        "created_at",
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def replay_dead(deliveries: DataFrame, now: Column, sink: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Dead rows become pending with a clean slate; also counts them per sink."""
    hit = F.col("status") == "dead"
    if sink is not None:
        hit = hit & (F.col("sink_key") == sink)
    table = deliveries.select(
        "sink_key", "event_id",
        F.when(hit, "pending").otherwise(F.col("status")).alias("status"),
        F.when(hit, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(~hit, F.col("next_attempt_at")).alias("next_attempt_at"),
        F.when(~hit, F.col("last_error")).alias("last_error"),
        F.when(~hit, F.col("delivered_at")).alias("delivered_at"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    counts = deliveries.groupBy("sink_key").agg(F.count_if(hit).alias("replayed"))
    return table, counts
