"""Source health and the delay before the next run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.plans import CHUNK, trailing_count
from rillflow.schemas import SOURCE_HEALTH

# Run policy defaults.
INTERVAL = 60.0
FAILURE_THRESHOLD = 5
COOLDOWN = 300.0
BACKOFF_BASE = 5.0


def rate_limit_delay(rate_limit: Column, now: Column) -> Column:
    """Seconds a rate limit asks for: Retry-After, else the time to reset when nothing remains."""
    wait = rate_limit["retry_after"].cast("double")
    asked = F.when(wait.isNotNull(), F.greatest(wait, F.lit(0.0)))
    to_reset = F.greatest(
        (F.unix_micros(rate_limit["reset_at"]) - F.unix_micros(now)) / F.lit(1e6), F.lit(0.0)
    )
    return F.coalesce(asked, F.when(rate_limit["remaining"] == 0, to_reset), F.lit(0.0))


def next_delay(
    success: Column,
    failures: Column,
    error_kind: Column,
    limited: Column,
    interval: float = INTERVAL,
    threshold: int = FAILURE_THRESHOLD,
    cooldown: float = COOLDOWN,
    base: float = BACKOFF_BASE,
) -> Column:
    """Seconds to the next run. An open circuit comes before any rate limit."""
    grown = F.least(
        F.lit(interval),
        F.lit(base) * F.pow(F.lit(2.0), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(60))),
    )
    return (
        F.when(success, F.greatest(F.lit(interval), limited))
        .when(failures >= threshold, F.lit(cooldown))
        .when((error_kind == "rate_limit") & (limited > 0), limited)
        .otherwise(grown)
    )


def status_of(success: Column, failures: Column, threshold: int) -> Column:
    return (
        F.when(success, "healthy").when(failures >= threshold, "circuit_open").otherwise("degraded")
    )


def run_outcomes(
    run_log: DataFrame,
    prior: DataFrame | None = None,
    threshold: int = FAILURE_THRESHOLD,
    interval: float = INTERVAL,
    cooldown: float = COOLDOWN,
    base: float = BACKOFF_BASE,
    chunk: int = CHUNK,
) -> DataFrame:
    """Every run with the failures in a row up to it, its status and the delay after it.

    ``run_id`` is a unique integer per source in run order. A source with a large part of the log is
    cut by ``run_id``. ``prior`` health adds its failures to runs before the first success.
    """
    flagged = run_log.withColumn("_failed", ~F.col("success"))
    runs = trailing_count(
        flagged, ["source_key"], "run_id", "success", "_failed", "failures", chunk
    )
    if prior is not None:
        first_ok = run_log.filter("success").groupBy("source_key").agg(F.min("run_id").alias("_ok"))
        start = prior.select("source_key", F.col("consecutive_failures").alias("_prior")).join(
            first_ok, "source_key", "left"
        )
        runs = runs.join(start, "source_key", "left")
        before = F.col("_ok").isNull() | (F.col("run_id") < F.col("_ok"))
        runs = runs.withColumn(
            "failures",
            F.col("failures") + F.when(before, F.coalesce("_prior", F.lit(0))).otherwise(0),
        ).drop("_prior", "_ok")
    limited = rate_limit_delay(F.col("rate_limit"), F.col("finished_at"))
    return runs.drop("_failed").withColumn(
        "status", status_of(F.col("success"), F.col("failures"), threshold)
    ).withColumn(
        "delay",
        next_delay(
            F.col("success"), F.col("failures"), F.col("error_kind"), limited,
            interval, threshold, cooldown, base,
        ),
    )


def fold_health(
    run_log: DataFrame, prior: DataFrame | None = None, threshold: int = FAILURE_THRESHOLD
) -> DataFrame:
    """Health rows after a run log. Two aggregates that combine before their shuffle.

    The failures in a row are those after the source's last success.
    """
    key = "source_key"
    last_ok = run_log.filter("success").groupBy(key).agg(
        F.max("run_id").alias("_ok"), F.max_by("finished_at", "run_id").alias("_ok_at")
    )
    totals = run_log.groupBy(key).agg(
        F.count("*").alias("_runs"),
        F.sum(F.when(F.col("success"), F.coalesce("event_count", F.lit(0))).otherwise(0)).alias("_events"),
        F.max_by(F.struct("success", "attempted_at", "finished_at", "error"), "run_id").alias("_last"),
    )
    # Joined rows are failures only; a hot source meets a single row and is split at run time.
    trailing = (
        run_log.filter("NOT success").select(key, "run_id")
        .join(last_ok.select(key, "_ok"), key, "left")
        .filter(F.col("_ok").isNull() | (F.col("run_id") > F.col("_ok")))
        .groupBy(key).agg(F.count("*").alias("_tail"))
    )
    joined = totals.join(last_ok, key, "left").join(trailing, key, "left")
    if prior is None:
        carried, runs, events, ok_at = F.lit(0), F.lit(0), F.lit(0), F.lit(None).cast("timestamp")
    else:
        old = prior.select(
            key,
            F.col("consecutive_failures").alias("_p_fail"), F.col("total_runs").alias("_p_runs"),
            F.col("total_events").alias("_p_events"), F.col("last_success_at").alias("_p_ok"),
        )
        joined = joined.join(old, key, "left")
        carried = F.when(F.col("_ok").isNull(), F.coalesce("_p_fail", F.lit(0))).otherwise(0)
        runs, events, ok_at = F.coalesce("_p_runs", F.lit(0)), F.coalesce("_p_events", F.lit(0)), F.col("_p_ok")
    failures = (F.coalesce("_tail", F.lit(0)) + carried).cast("int")
    return joined.select(
        key,
        status_of(F.col("_last.success"), failures, threshold).alias("status"),
        F.col("_last.finished_at").alias("updated_at"),
        F.col("_last.attempted_at").alias("last_attempt_at"),
        F.coalesce("_ok_at", ok_at).alias("last_success_at"),
        F.when(~F.col("_last.success"), F.col("_last.error")).alias("last_error"),
        failures.alias("consecutive_failures"),
        (F.col("_runs") + runs).alias("total_runs"),
        (F.col("_events") + events).alias("total_events"),
    )


def apply_health(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace the rows of updated sources, keep the others."""
    names = SOURCE_HEALTH.fieldNames()
    kept = stored.select(*names).join(updates.select("source_key"), "source_key", "left_anti")
    return kept.select(*names).unionByName(updates.select(*names))


def list_health(health: DataFrame) -> DataFrame:
    return health.orderBy("source_key")


def run_success(outcomes: DataFrame, pass_result: DataFrame) -> DataFrame:
    """Whether a cycle went well: every source succeeded and nothing failed or died."""
    sources = outcomes.agg(F.coalesce(F.bool_and("success"), F.lit(True)).alias("x"))
    sinks = pass_result.agg(
        F.coalesce(F.bool_and((F.col("failed") == 0) & (F.col("dead") == 0)), F.lit(True)).alias("y")
    )
    return sources.select((F.col("x") & sinks.scalar()).alias("success"))
