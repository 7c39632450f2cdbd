"""Where events go: console, JSON lines, webhook requests, or a caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import event_json, idempotency_key
from rillflow.sources.registry import Registry

# Response statuses that are worth another delivery attempt.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)

Send = Callable[[str, dict, str], tuple[int | None, str | None, str | None]]


def to_event_json(signals: DataFrame) -> DataFrame:
    return signals.select("id", event_json().alias("event"))


def write_console(signals: DataFrame) -> None:
    """Print every event, one JSON object per line; the driver holds one partition at a time."""
    for row in to_event_json(signals).select("event").toLocalIterator():
        print(row["event"])


def write_jsonl(signals: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append one event object per line. A batch id gives the rows a folder that a replay replaces."""
    lines = signals.select(event_json().alias("value"))
    if batch_id is None:
        lines.write.mode("append").text(path)
    else:
        lines.write.mode("overwrite").text(f"{path}/batch_id={batch_id}")


def webhook_requests(ready: DataFrame, sink: str, token: str | None = None, prefix: str = "rillflow") -> DataFrame:
    """``(event_id, headers, body)`` of each event; ``ready`` has the signal columns."""
    pairs: list[Column] = [
        F.lit("Content-Type"), F.lit("application/json"),
        F.lit("Idempotency-Key"), idempotency_key(F.lit(sink), F.col("id"), F.col("event_hash"), prefix),
        F.lit("X-Event-ID"), F.col("id"),
        F.lit("X-Event-Hash"), F.col("event_hash"),
    ]
    if token:
        pairs += [F.lit("Authorization"), F.lit(f"Bearer {token}")]
    return ready.select(
        F.col("id").alias("event_id"), F.col("event_hash").alias("sent_hash"),
        F.create_map(*pairs).alias("headers"), event_json().alias("body"),
    )


def send_requests(requests: DataFrame, url: str, send: Send) -> DataFrame:
    """Send from the executors with a caller-supplied function, row by row inside each batch.

    ``send(url, headers, body)`` returns ``(status, retry_after, failure)``. A retried task sends
    again; the idempotency key lets the receiver tell.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            answers = [send(url, dict(h), b) for h, b in zip(rows["headers"], rows["body"])]
            yield pd.DataFrame(
                {
                    "event_id": rows["event_id"].to_numpy(),
                    "sent_hash": rows["sent_hash"].to_numpy(),
                    "status": pd.array([a[0] for a in answers], dtype="Int32"),
                    "retry_after_text": [a[1] for a in answers],
                    "failure": [a[2] for a in answers],
                }
            )

    return requests.mapInPandas(
        run, "event_id string, sent_hash string, status int, retry_after_text string, failure string"
    )


def classify_responses(responses: DataFrame) -> DataFrame:
    """Add ``outcome``, ``retry_after`` and ``error``: 2xx succeed, some statuses may be retried.

    Only a numeric Retry-After counts; negatives read as zero.
    """
    status = F.col("status")
    good = (status >= 200) & (status < 300)
    wait = F.col("retry_after_text").try_cast("double")
    outcome = (
        F.when(F.col("failure").isNotNull(), "retryable")
        .when(good, "success")
        .when(status.isin(*RETRYABLE), "retryable")
        .otherwise("permanent")
    )
    error = F.when(
        F.col("failure").isNotNull(), F.concat(F.lit("webhook network error: "), F.col("failure"))
    ).when(~good, F.concat(F.lit("webhook HTTP "), status.cast("string")))
    return (
        responses.withColumn("outcome", outcome)
        .withColumn(
            "retry_after",
            F.when(
                (F.col("outcome") != "success") & F.col("failure").isNull() & wait.isNotNull(),
                F.greatest(wait, F.lit(0.0)),
            ),
        )
        .withColumn("error", error)
    )


def default_sinks() -> Registry:
    """Sink functions ``fn(signals, batch_id, **options)`` by type, for ``foreachBatch``."""
    registry = Registry("sink")
    registry.register("stdout", lambda df, batch_id: write_console(df))
    registry.register("jsonl", lambda df, batch_id, path: write_jsonl(df, path, batch_id))
    registry.register(
        "webhook",
        lambda df, batch_id, key, url, send, token=None: classify_responses(
            send_requests(webhook_requests(df, key, token), url, send)
        ),
    )
    return registry


def register_sink(registry: Registry, name: str, fn: Callable) -> None:
    """Add a sink function of one's own: ``fn(signals, batch_id, **options)``."""
    registry.register(name, fn)
