"""Delivery passes: what is ready, what a result does to a row, and whole attempt logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.outbox import COLUMNS
from rillflow.plans import top_per_key

# Delivery policy defaults.
BATCH = 100
MAX_ATTEMPTS = 8
BACKOFF_BASE = 5.0
BACKOFF_MAX = 3600.0
OPEN = ("pending", "failed")
GONE = "event no longer exists"


def ready(deliveries: DataFrame, now: Column, limit: int = BATCH) -> DataFrame:
    """Oldest open rows per sink whose next attempt is due."""
    due = deliveries.filter(
        F.col("status").isin(*OPEN)
        & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    )
    return top_per_key(
        due, ["sink_key"], [F.col("updated_at"), F.col("event_id")], max(0, limit), rank="position"
    )


def backoff_seconds(
    prior: Column, retry_after: Column, base: float = BACKOFF_BASE, cap: float = BACKOFF_MAX
) -> Column:
    """Retry-After held within [0, cap], else base doubled per earlier attempt, capped."""
    held = F.least(F.greatest(retry_after.cast("double"), F.lit(0.0)), F.lit(cap))
    asked = F.when(retry_after.isNotNull(), held)
    grown = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(prior, F.lit(60))), F.lit(cap))
    return F.coalesce(asked, grown)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.round(seconds * 1_000_000).cast("long"))


def match_events(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Ready rows with the event they deliver; ``event_hash`` is null where the event is gone."""
    events = signals.select(F.col("id").alias("event_id"), "event_hash")
    return rows.join(events, "event_id", "left")


def apply_outcomes(
    deliveries: DataFrame,
    attempts: DataFrame,
    signals: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    base: float = BACKOFF_BASE,
    cap: float = BACKOFF_MAX,
) -> DataFrame:
    """The delivery table after one pass, plus what happened (``result``; null where not attempted).

    ``attempts`` has one row per ``(sink_key, event_id)`` with ``outcome`` success, retryable,
    permanent or missing, ``sent_hash``, ``prior_attempts`` as read before sending, ``retry_after``,
    ``error`` and ``attempted_at``. A success for a version that is no longer current leaves the row
    as it is; failures are not compared with the version.
    """
    current = signals.select(F.col("id").alias("event_id"), F.col("event_hash").alias("_now_hash"))
    tried = attempts.select(
        "sink_key", "event_id", "outcome", "sent_hash", "prior_attempts",
        "retry_after", "error", "attempted_at",
    ).join(current, "event_id", "left")
    joined = deliveries.select(*COLUMNS).join(tried, ["sink_key", "event_id"], "left")
    stale = ~F.col("sent_hash").eqNullSafe(F.col("_now_hash")) | F.col("_now_hash").isNull()
    gives_up = (
        F.col("outcome").isin("permanent", "missing")
        | (F.col("prior_attempts") + 1 >= max_attempts)
    )
    result = (
        F.when(F.col("outcome").isNull(), F.lit(None).cast("string"))
        .when((F.col("outcome") == "success") & stale, "superseded")
        .when(F.col("outcome") == "success", "delivered")
        .when(gives_up, "dead")
        .otherwise("failed")
    )
    r = F.col("result")
    moved = F.coalesce(r.isin("delivered", "dead", "failed"), F.lit(False))
    due = plus_seconds(
        F.col("attempted_at"), backoff_seconds(F.col("prior_attempts"), F.col("retry_after"), base, cap)
    )
    error = F.when(F.col("outcome") == "missing", GONE).otherwise(F.col("error"))
    return joined.withColumn("result", result).select(
        "sink_key", "event_id",
        F.when(moved, r).otherwise(F.col("status")).alias("status"),
        (F.col("attempts") + F.when(moved, 1).otherwise(0)).alias("attempts"),
        F.when(~moved, F.col("next_attempt_at")).when(r == "failed", due).alias("next_attempt_at"),
        F.when(~moved, F.col("last_error")).when(r != "delivered", error).alias("last_error"),
        F.when(moved & (r == "delivered"), F.col("attempted_at"))
        .otherwise(F.col("delivered_at")).alias("delivered_at"),
        F.when(moved, F.col("attempted_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        "result",
    )


def pass_summary(outcomes: DataFrame) -> DataFrame:
    """Per sink: rows attempted and how they ended."""
    r = F.col("result")
    return (
        outcomes.filter(r.isNotNull())
        .groupBy("sink_key")
        .agg(
            F.count("*").alias("attempted"),
            *[F.count_if(r == x).alias(x) for x in ("delivered", "failed", "dead", "superseded")],
        )
    )


def fold_deliveries(
    queued: DataFrame,
    attempts: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    base: float = BACKOFF_BASE,
    cap: float = BACKOFF_MAX,
) -> DataFrame:
    """Final delivery rows of two logs ordered by one shared integer ``seq``.

    ``queued(sink_key, event_id, event_hash, seq, at)`` holds every (re)queueing, ``attempts`` every
    send with its ``outcome``. Only attempts after the last queueing count; a success for an older
    hash counts for nothing. The queue side of the join has one row per delivery, so adaptive execution
    can split a delivery with very many attempts.
    """
    keys = ["sink_key", "event_id"]
    last = (
        queued.groupBy(*keys)
        .agg(F.max(F.struct("seq", "event_hash", "at")).alias("q"))
        .select(*keys, F.col("q.seq").alias("_seq"), F.col("q.event_hash").alias("_hash"), F.col("q.at").alias("_at"))
    )
    tried = attempts.select(
        *keys, F.col("seq").alias("_try"), "outcome", "sent_hash", "retry_after", "error", "attempted_at"
    )
    counts = (F.col("_try") > F.col("_seq")) & (
        (F.col("outcome") != "success") | F.col("sent_hash").eqNullSafe(F.col("_hash"))
    )
    same = [last[k] == tried[k] for k in keys]
    folded = (
        last.join(tried, [*same, counts], "left")
        .groupBy(*[last[k] for k in keys])
        .agg(
            F.max("_at").alias("queued_at"),
            F.count("_try").cast("int").alias("n"),
            F.max(
                F.when(
                    F.col("_try").isNotNull(),
                    F.struct("_try", "attempted_at", "outcome", "retry_after", "error"),
                )
            ).alias("t"),
            F.max(
                F.when(F.col("outcome") == "success", F.struct("_try", "attempted_at"))
            ).alias("ok"),
        )
    )
    n, outcome = F.col("n"), F.col("t.outcome")
    status = (
        F.when(outcome.isNull(), "pending")
        .when(outcome == "success", "delivered")
        .when(outcome.isin("permanent", "missing") | (n >= max_attempts), "dead")
        .otherwise("failed")
    )
    due = plus_seconds(
        F.col("t.attempted_at"), backoff_seconds(n - 1, F.col("t.retry_after"), base, cap)
    )
    return folded.withColumn("status", status).select(
        *keys, "status",
        n.alias("attempts"),
        F.when(F.col("status") == "failed", due).alias("next_attempt_at"),
        F.when(F.col("status").isin("failed", "dead"), F.col("t.error")).alias("last_error"),
        F.col("ok.attempted_at").alias("delivered_at"),
        F.coalesce("t.attempted_at", "queued_at").alias("updated_at"),
    )


def get_delivery(deliveries: DataFrame, sink: str, event_id: str) -> DataFrame:
    return deliveries.filter((F.col("sink_key") == sink) & (F.col("event_id") == event_id))
