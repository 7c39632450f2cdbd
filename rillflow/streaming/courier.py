"""Delivery as a stream: each (sink, event) is a state machine of its own, with a timer for its next attempt.

Rows of the queue come in at least once; a row whose ``seq`` is not above the one a delivery stands at is ignored. A
newer row resets the delivery and is sent at once; a failure that may be repeated sets a processing-time timer for the
backoff or the receiver's Retry-After, and the timer sends again without any new input. State is spread by sink and buckets of
events, so a hot sink is no hot task; requests are kept only while a delivery is open.

Times are those Spark recorded for the micro-batch, so a batch that is run again writes the same rows. It also
sends again: the idempotency key lets the receiver tell.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from rillflow.operators import delivery, sinks
from rillflow.operators.outbox import COLUMNS
from rillflow.operators.store import Store, create_path, path_exists
from rillflow.schemas import DELIVERIES
from rillflow.session import shared_dir

KEYS = ("sink_key", "event_id")
#: A queued request; ``body`` is null where the event is gone.
QUEUE = "sink_key string, event_id string, seq bigint, event_hash string, headers map<string,string>, body string, at timestamp"
#: What a delivery is after an attempt or a reset, and the attempt itself.
MOVES = (
    "sink_key string, event_id string, seq bigint, status string, attempts int, next_attempt_at timestamp, last_error string, delivered_at timestamp, "
    "updated_at timestamp, sent_hash string, outcome string, retry_after double, error string, attempted_at timestamp"
)
#: Groups of a sink's events, by hash, that share a ledger and a timer. A stream keeps the number it was started with.
BUCKETS = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a closed delivery remembers which row of the queue it stands at.
REMEMBERED_MS = 7 * 24 * 3600 * 1000


class Target(NamedTuple):
    """Where a sink's requests go; ``send(url, headers, body)`` returns ``(status, retry_after, failure)``."""

    url: str
    send: sinks.Send


class Policy(NamedTuple):
    max_attempts: int = delivery.MAX_ATTEMPTS
    base: float = delivery.BACKOFF_BASE
    cap: float = delivery.BACKOFF_MAX


class Answer(NamedTuple):
    outcome: str
    retry_after: float | None
    error: str | None


def answer_of(status: int | None, retry_after: str | None, failure: str | None) -> Answer:
    """One response as ``sinks.classify_responses`` has it."""
    if failure is not None:
        return Answer("retryable", None, f"webhook network error: {failure}")
    if status is not None and 200 <= status < 300:
        return Answer("success", None, None)
    try:
        wait = max(0.0, float(retry_after)) if retry_after is not None else None
    except ValueError:
        wait = None
    return Answer("retryable" if status in sinks.RETRYABLE else "permanent", wait, f"webhook HTTP {status}")


def wait_seconds(prior: int, retry_after: float | None, policy: Policy) -> float:
    """As ``delivery.backoff_seconds``, for one failure after ``prior`` earlier ones."""
    if retry_after is not None:
        return min(max(retry_after, 0.0), policy.cap)
    return min(policy.base * 2.0 ** min(prior, 60), policy.cap)


class _Machine(StatefulProcessor):
    """The deliveries of one bucket of a sink: a ledger of where each stands, the requests of those that are sent again, one timer."""

    def __init__(self, targets: Mapping[str, Target], policy: Policy) -> None:
        self.targets, self.policy = dict(targets), policy

    def init(self, handle) -> None:
        self.handle = handle
        self.ledger = handle.getValueState("ledger", "held string")
        self.requests = handle.getValueState("requests", "held string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = {}
        for row in rows:
            if row["event_id"] not in newest or row["seq"] > newest[row["event_id"]]["seq"]:
                newest[row["event_id"]] = row
        ledger, now = self._opened(), timerValues.getCurrentProcessingTimeInMs()
        for event, row in newest.items():
            stands = ledger["open"].get(event) or ledger["closed"].get(event)
            if stands is not None and stands[0] >= row["seq"]:
                continue
            headers = json.dumps(dict(row["headers"]) if row["headers"] is not None else {})
            yield self._attempt(ledger, key[0], event, row["seq"], (row["event_hash"], headers, row["body"], 0), row["at_ms"], now)
        self._keep(ledger, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ledger, now = self._opened(), timerValues.getCurrentProcessingTimeInMs()
        ledger["timer"] = None
        for event, (seq, due) in list(ledger["open"].items()):
            if due is not None and due <= now:
                yield self._attempt(ledger, key[0], event, seq, self._waiting()[event], None, now)
        ledger["closed"] = {event: stands for event, stands in ledger["closed"].items() if stands[1] > now}
        self._keep(ledger, now)

    def _opened(self) -> dict:
        """``open``: seq and when to send again; ``closed``: seq and till when it is remembered; ``timer``: the one that is set."""
        held, self.waiting, self.changed = self.ledger.get(), None, False
        return json.loads(held[0]) if held is not None else {"open": {}, "closed": {}, "timer": None}

    def _waiting(self) -> dict:
        """Requests that are sent again, by event; read once for a bucket, and only if one of them is."""
        if self.waiting is None:
            held = self.requests.get()
            self.waiting = json.loads(held[0]) if held is not None else {}
        return self.waiting

    def _forget(self, event: str) -> None:
        self._waiting().pop(event, None)
        self.changed = True

    def _keep(self, ledger: dict, now: int) -> None:
        times = [at for _, at in (*ledger["open"].values(), *ledger["closed"].values()) if at is not None]
        first = min(times, default=None)
        if first != ledger["timer"]:
            if ledger["timer"] is not None:
                self.handle.deleteTimer(ledger["timer"])
            # One set for the present goes with the timer that has just fired.
            ledger["timer"] = None if first is None else max(first, now + 1)
            if first is not None:
                self.handle.registerTimer(ledger["timer"])
        if self.changed and self.waiting:
            self.requests.update((json.dumps(self.waiting),))
        elif self.changed:
            self.requests.clear()
        if ledger["open"] or ledger["closed"]:
            self.ledger.update((json.dumps(ledger),))
        else:
            self.ledger.clear()

    def _attempt(self, ledger: dict, sink: str, event: str, seq: int, request: tuple, queued_at: int | None, now: int) -> Row:
        event_hash, headers, body, prior = request
        was_open = ledger["open"].pop(event, None) is not None
        ledger["closed"].pop(event, None)
        key, target = (sink, event), self.targets.get(sink)
        if target is None:  # no receiver yet: the row waits for its next queueing
            if was_open:
                self._forget(event)
            ledger["open"][event] = (seq, None)
            return self._move(key, seq, "pending", prior, None, None, None, queued_at, None, None, None)
        if body is None:
            answer = Answer("missing", None, None)
        else:
            sent = {**json.loads(headers), "X-Attempt": str(prior + 1)}
            try:
                answer = answer_of(*target.send(target.url, sent, body))
            except Exception as failure:  # noqa: BLE001 - whatever the caller's function raises is one failed attempt
                answer = answer_of(None, None, str(failure) or type(failure).__name__)
        tries = prior + 1
        error = delivery.GONE if answer.outcome == "missing" else answer.error
        if answer.outcome == "retryable" and tries < self.policy.max_attempts:
            due = now + round(wait_seconds(prior, answer.retry_after, self.policy) * 1000)
            ledger["open"][event] = (seq, due)
            self._waiting()[event] = (event_hash, headers, body, tries)
            self.changed = True
            return self._move(key, seq, "failed", tries, due, error, None, now, event_hash, answer, now)
        if was_open:
            self._forget(event)
        ledger["closed"][event] = (seq, now + REMEMBERED_MS)
        good = answer.outcome == "success"
        return self._move(key, seq, "delivered" if good else "dead", tries, None, error, now if good else None, now, event_hash, answer, now)

    @staticmethod
    def _move(key, seq, status, attempts, due, error, delivered_at, updated_at, sent_hash, answer, at) -> Row:
        outcome, retry_after, failure = answer or (None, None, None)
        return Row(
            sink_key=key[0], event_id=key[1], seq=seq, status=status, attempts=attempts, next_attempt_at=due, last_error=error, delivered_at=delivered_at,
            updated_at=updated_at, sent_hash=sent_hash, outcome=outcome, retry_after=retry_after, error=failure, attempted_at=at,
        )


def moves(queue: DataFrame, targets: Mapping[str, Target], policy: Policy = Policy()) -> DataFrame:
    """A streaming queue (``QUEUE``) as the stream of what becomes of its deliveries (``MOVES``).

    Deliveries are dealt to ``BUCKETS`` per sink: what a state store asks of each key is paid once for the rows of a bucket.
    Times are milliseconds in there.
    """
    asked = queue.withColumns({"bucket": F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)), "at_ms": F.unix_millis("at")}).drop("at")
    made = asked.groupBy("sink_key", "bucket").transformWithState(_Machine(targets, policy), MOVES.replace("timestamp", "bigint"), "Update", "ProcessingTime")
    times = [f.name for f in StructType.fromDDL(MOVES) if f.dataType.typeName() == "timestamp"]
    return made.withColumns({c: F.timestamp_millis(c) for c in times})


def publish(store: Store, folder: str, token: str | None = None, prefix: str = "rillflow") -> list[int]:
    """Write the requests that committed batches queued, one folder a version; returns the versions that were new.

    A row of ``deliveries`` that a batch left pending is a request with the event as of now, numbered by the version. A
    marker follows each folder, so a crash between them writes the folder again, which the stream's ``seq`` makes harmless.
    """
    done = []
    pending = store.log("deliveries", DELIVERIES).filter("status = 'pending'")
    for (version,) in store.commits().select("version").orderBy("version").collect():
        mark = f"{folder}-published/{version}"
        if path_exists(store.spark, mark):
            continue
        rows = pending.filter(F.col("version") == version).select(*KEYS, F.col("updated_at").alias("at"))
        asked = rows.select(F.col("event_id").alias("id")).distinct()
        events = store.current("signals", ["seq"], only=asked)
        requests = sinks.webhook_requests(events, "", token, prefix).select("event_id", F.col("sent_hash").alias("event_hash"), "headers", "body")
        joined = rows.join(requests, "event_id", "left")
        key = F.concat(
            F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat_ws("\x1f", "sink_key", "event_id", F.coalesce("event_hash", F.lit(""))), 256), 1, 32),
        )
        headers = F.when(F.col("body").isNotNull(), F.map_concat(F.map_filter("headers", lambda k, _: k != "Idempotency-Key"), F.create_map(F.lit("Idempotency-Key"), key)))
        joined.select(*KEYS, F.lit(version).cast("bigint").alias("seq"), "event_hash", headers.alias("headers"), "body", "at").write.mode("overwrite").parquet(f"{folder}/version={version}")
        create_path(store.spark, mark)
        done.append(version)
    return done


def stream_queue(store: Store, folder: str, max_files: int = 100) -> DataFrame:
    """The published requests as a stream."""
    return store.spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/*")


class Courier:
    """The delivery stream over a store: its rows are committed to ``deliveries``, its attempts to ``delivery_attempts``."""

    def __init__(self, store: Store, targets: Mapping[str, Target], policy: Policy = Policy(), stream_id: str = "courier") -> None:
        self.store, self.targets, self.policy, self.stream_id = store, targets, policy, stream_id

    def start(self, queue: DataFrame, checkpoint: str | None = None, every: str = "5 seconds") -> StreamingQuery:
        """Runs until it is stopped; timers fire with each trigger, with or without new requests."""
        spark = self.store.spark
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        # A batch stores what it changed, not the whole state again.
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        checkpoint = checkpoint or f"{shared_dir(spark)}/{self.stream_id}"
        writer = moves(queue, self.targets, self.policy).writeStream.outputMode("update").foreachBatch(self.record)
        return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    def settled(self, queue: DataFrame) -> bool:
        """Whether every row of the queue (read as a table) was taken up and none is left that will be sent again by itself."""
        if not path_exists(self.store.spark, self.store.path("moves")):
            return queue.isEmpty()
        done = self.store.log("moves", StructType.fromDDL(MOVES)).groupBy(*KEYS).agg(
            F.max(F.struct("seq", "attempts")).alias("at"), F.max_by("status", F.struct("seq", "attempts")).alias("status"),
        )
        asked = queue.groupBy(*KEYS).agg(F.max("seq").alias("seq"))
        behind = asked.join(done, list(KEYS), "left").filter("at IS NULL OR at.seq < seq OR status = 'failed'")
        return behind.isEmpty()

    def run_until_settled(self, folder: str, checkpoint: str | None = None, every: str = "1 second", seconds: float = 600) -> bool:
        """Deliver what is published in ``folder`` with all its retries, then stop; false if nothing moves for ``seconds``."""
        query, seen, end = self.start(stream_queue(self.store, folder), checkpoint, every), None, time.monotonic() + seconds
        try:
            while time.monotonic() < end:
                last = query.lastProgress
                if last is not None and last["numInputRows"] and last["batchId"] != seen:
                    seen, end = last["batchId"], time.monotonic() + seconds
                query.awaitTermination(1)
                if not query.isActive:
                    raise RuntimeError(f"the delivery stream stopped: {query.exception()}")
                # While requests still come in there is no need to compare the tables, which the batches would wait for.
                if not self._idle(query):
                    continue
                if self.settled(self.store.spark.read.schema(QUEUE).parquet(f"{folder}/*")):
                    return True
            return False
        finally:
            query.stop()

    @staticmethod
    def _idle(query: StreamingQuery) -> bool:
        """Whether the last batch that ended found no new request; timers may still be set."""
        last = query.lastProgress
        return last is not None and last["numInputRows"] == 0

    def record(self, batch: DataFrame, batch_id: int) -> None:
        """The last row of each delivery, and every attempt, as one committed batch; one without rows leaves no trace."""
        if self.store.is_committed(self.stream_id, batch_id):
            return
        self.store.write("moves", self.stream_id, batch_id, batch)
        made = self.store.read_batch("moves", batch.schema, self.stream_id, batch_id)
        if made.isEmpty():
            return
        newest = made.groupBy(*KEYS).agg(F.max_by(F.struct(*COLUMNS[2:]), F.struct("seq", "attempts")).alias("r")).select(*KEYS, "r.*")
        tried = made.filter("outcome IS NOT NULL").select(*KEYS, "seq", F.col("attempts").alias("attempt"), "sent_hash", "attempted_at", "outcome", "retry_after", "error")
        self.store.commit(self.stream_id, batch_id, {"deliveries": newest, "delivery_attempts": tried})
