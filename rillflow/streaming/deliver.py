"""Delivery passes over a store: read what is due, send, record what happened."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators import delivery, outbox, sinks
from rillflow.operators.store import Conflict, Store
from rillflow.schemas import DELIVERIES, columns

_READY = columns(
    "sink_key string, event_id string, prior_attempts int, queued_at timestamp, sent_hash string, "
    "headers map, body string, status string, next_attempt_at timestamp, last_error string, delivered_at timestamp",
    headers=T.MapType(T.StringType(), T.StringType()),
)
_SENT = columns(
    "event_id string, sent_hash string, status int, retry_after_text string, failure string"
)

# Versions after which a pass folds the deliveries into a base, in which open and closed rows lie apart.
FOLD_AFTER = 100
# How often a pass is derived anew when other batches are committed meanwhile, and the seconds between.
TRIES, PAUSE = 20, 0.5

_OUTCOMES = T.StructType([*DELIVERIES.fields, T.StructField("result", T.StringType())])


class Delivery:
    """One sink's worker. Passes of different sinks touch different rows and never wait for another.

    ``send(url, headers, body)`` runs on the executors and returns ``(status, retry_after, failure)``.
    """

    def __init__(
        self, store: Store, sink: str, url: str, send: sinks.Send, token: str | None = None,
        limit: int = delivery.BATCH, max_attempts: int = delivery.MAX_ATTEMPTS,
        fold_after: int = FOLD_AFTER,
    ) -> None:
        self.store, self.sink, self.url, self.send = store, sink, url, send
        self.token, self.limit, self.max_attempts, self.fold_after = token, limit, max_attempts, fold_after

    @property
    def stream_id(self) -> str:
        return f"deliver-{self.sink}"

    def run_pass(self, pass_id: int, now=None) -> DataFrame:
        """Send one batch and commit the outcomes; returns the pass summary.

        Rows, events and requests are read in one go and written before anything is sent, so a pass sends the
        versions it has read, and an event is gone only if it was gone then. A row that was queued again
        meanwhile is left as it is now (``superseded``). The outcomes are committed only if no other batch was
        committed since the state they were compared with; else they are derived again, without sending.
        A committed pass is not sent again; one that failed before its commit is, and the idempotency keys
        let the receiver tell.

        Of the deliveries a pass reads the open ones and what was committed since the last fold, never those that were
        closed before; the rows as they are now are those it has read and the commits since.
        """
        store, sid = self.store, self.stream_id
        if store.is_committed(sid, pass_id):
            return delivery.pass_summary(store.read_batch("outcomes", _OUTCOMES, sid, pass_id))
        at = F.current_timestamp() if now is None else now
        self._since = store.version()
        mine = store.current("deliveries", among=delivery.OPEN, as_of=self._since).filter(F.col("sink_key") == self.sink)
        rows = delivery.ready(mine, at, self.limit)
        asked = rows.select(F.col("event_id").alias("id"))
        requests = sinks.webhook_requests(store.current("signals", ["seq"], only=asked), self.sink, self.token)
        due = rows.select(
            "sink_key", "event_id", F.col("attempts").alias("prior_attempts"), F.col("updated_at").alias("queued_at"),
            "status", "next_attempt_at", "last_error", "delivered_at",
        ).join(requests, "event_id", "left")
        store.write("ready", sid, pass_id, due.select(*_READY.fieldNames()))
        due = store.read_batch("ready", _READY, sid, pass_id)
        answers = sinks.send_requests(due.filter("body IS NOT NULL"), self.url, self.send)
        store.write("responses", sid, pass_id, answers)
        for attempt in range(TRIES):
            seen = store.version()
            self._outcomes(due, pass_id, at)
            done = store.read_batch("outcomes", _OUTCOMES, sid, pass_id)
            store.write("deliveries", sid, pass_id, done.filter(F.col("result") != "superseded").select(*outbox.COLUMNS))
            try:
                # A committer that died with its claim would block for ever: the last try takes the next free version.
                store.commit(sid, pass_id, after=seen if attempt < TRIES - 1 else None)
                break
            except Conflict:
                time.sleep(PAUSE)
        store.compact_after("deliveries", self.fold_after)
        return delivery.pass_summary(done)

    def _now(self, due: DataFrame) -> DataFrame:
        """The delivery rows of a pass as they are now: as read, or as the last commit since has left them."""
        keys = ["sink_key", "event_id"]
        rest = [c for c in outbox.COLUMNS if c not in keys]
        read = due.withColumns({"attempts": F.col("prior_attempts"), "updated_at": F.col("queued_at"), "version": F.lit(self._since).cast("bigint")})
        since = self.store.log("deliveries", DELIVERIES, self._since).join(due.select(*keys), keys, "left_semi")
        both = read.select(*outbox.COLUMNS, "version").unionByName(since)
        return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*keys, "r.*")

    def _outcomes(self, due: DataFrame, pass_id: int, at) -> None:
        """What the answers do to the delivery rows as they are now."""
        store, sid = self.store, self.stream_id
        sent = sinks.classify_responses(store.read_batch("responses", _SENT, sid, pass_id)).drop("sent_hash")
        attempts = due.join(sent, "event_id", "left").select(
            "sink_key", "event_id", F.coalesce("outcome", F.lit("missing")).alias("outcome"), "sent_hash",
            "prior_attempts", "queued_at", "retry_after", "error", at.alias("attempted_at"),
        )
        touched = self._now(due)
        chosen = due.select(F.col("event_id").alias("id"))
        versions = store.current("signals", ["seq"], names=["event_hash"], only=chosen)
        applied = delivery.apply_outcomes(touched, attempts, versions, self.max_attempts)
        # A row queued again since it was read has another time; what was sent says nothing about it.
        was = due.select("sink_key", "event_id", "queued_at")
        now = touched.select("sink_key", "event_id", *[F.col(c).alias(f"now_{c}") for c in outbox.COLUMNS if c not in ("sink_key", "event_id")])
        moved = ~F.col("queued_at").eqNullSafe(F.col("now_updated_at"))
        out = applied.join(was, ["sink_key", "event_id"]).join(now, ["sink_key", "event_id"])
        store.write(
            "outcomes", sid, pass_id,
            out.select(
                "sink_key", "event_id",
                *[F.when(moved, F.col(f"now_{c}")).otherwise(F.col(c)).alias(c) for c in outbox.COLUMNS if c not in ("sink_key", "event_id")],
                F.when(moved, "superseded").otherwise(F.col("result")).alias("result"),
            ).select(*_OUTCOMES.fieldNames()),
        )
