"""The ids a source has shown, remembered by a stream: which sightings are new, and the newest window of each source.

State is spread by source and id over ``BUCKETS``, so a hot source is no hot task. A bucket keeps the newest
``window`` of its own ids: the newest ``window`` of the source are always among them, so reading all buckets and ranking
gives exactly the window that ``operators.incremental.merge_seen`` keeps, wherever micro-batches end and however often the
stream is restarted. With a time to live, a bucket that has shown nothing for so long is forgotten; such a stream looks at its clock
for ever, so it keeps running and does not stop after what has landed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from rillflow.operators.incremental import ITEM, SEEN_FLOOR, SEEN_WINDOW
from rillflow.operators.store import Store
from rillflow.plans import top_per_key
from rillflow.session import shared_dir
from rillflow.streaming.courier import PROVIDER

BUCKETS = 64
#: A sighting: the place of an id in a poll of its source; and one with whether the id was new then.
SIGHTINGS = "source_key string, external_id string, poll_id bigint, pos bigint"
SEEN = SIGHTINGS + ", fresh boolean"


class _Window(StatefulProcessor):
    def __init__(self, window: int, ttl_ms: int | None) -> None:
        self.window, self.ttl_ms = window, ttl_ms

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "ids string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {i: (poll, pos) for i, poll, pos in json.loads(self.held.get()[0])} if self.held.exists() else {}
        shown = sorted({x for frame in rows for x in zip(frame["poll_id"].tolist(), frame["pos"].tolist(), frame["external_id"].tolist())})
        out = []
        for poll, pos, external_id in shown:
            was = held.get(external_id)
            if was is None or poll > was[0] or (poll == was[0] and pos < was[1]):
                held[external_id] = (poll, pos)
                out.append((key[0], external_id, poll, pos, was is None))
        newest = sorted(held.items(), key=lambda x: (-x[1][0], x[1][1], x[0]))[: self.window]
        self.held.update((json.dumps([(i, *at) for i, at in newest]),))
        if out:
            yield pd.DataFrame(out, columns=["source_key", "external_id", "poll_id", "pos", "fresh"])


def sightings(items: DataFrame, window: int = SEEN_WINDOW, floor: int = SEEN_FLOOR, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream of items (``SIGHTINGS``) as the stream of what changed (``SEEN``): new ids, and known ones shown again by a later poll.

    An id that left the window of its bucket is new when it returns. Rows without a source or an id are no items.
    """
    named = items.filter("source_key IS NOT NULL AND external_id IS NOT NULL").select(*[f.name for f in StructType.fromDDL(SIGHTINGS)])
    keyed = named.withColumn("bucket", F.pmod(F.xxhash64("external_id"), F.lit(buckets)))
    return keyed.groupBy("source_key", "bucket").transformWithStateInPandas(_Window(max(window, floor), ttl_ms), SEEN, "Update", "ProcessingTime" if ttl_ms else "None")


def remembered(seen: DataFrame, window: int = SEEN_WINDOW, floor: int = SEEN_FLOOR) -> DataFrame:
    """``(source_key, external_id, rank)``: the newest ``window`` ids of each source, those of the last poll first, in its order."""
    last = seen.groupBy(*ITEM).agg(F.min(F.struct((-F.col("poll_id")).alias("poll"), "pos")).alias("o"))
    return top_per_key(last, ["source_key"], [F.col("o"), F.col("external_id")], max(window, floor)).select(*ITEM, "rank")


class SeenStream:
    """The stream over a store: every batch's sightings are committed to the table ``seen``."""

    def __init__(self, store: Store, window: int = SEEN_WINDOW, stream_id: str = "seen", **limits) -> None:
        self.store, self.window, self.stream_id, self.limits = store, window, stream_id, limits

    def start(self, items: DataFrame, checkpoint: str | None = None, once: bool = True, every: str = "60 seconds") -> StreamingQuery:
        """Over what has landed, then stop, or keep running."""
        if once and self.limits.get("ttl_ms"):
            raise ValueError("a seen stream with a time to live keeps running: start it with once=False")
        spark = self.store.spark
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        writer = sightings(items, self.window, **self.limits).writeStream.outputMode("update").foreachBatch(self.record)
        writer = writer.option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/{self.stream_id}")
        return writer.trigger(**({"availableNow": True} if once else {"processingTime": every})).start()

    def record(self, batch: DataFrame, batch_id: int) -> None:
        if not self.store.is_committed(self.stream_id, batch_id):
            self.store.commit(self.stream_id, batch_id, {"seen": batch})

    def log(self) -> DataFrame:
        return self.store.log("seen", StructType.fromDDL(SEEN))

    def window_now(self) -> DataFrame:
        return remembered(self.log(), self.window)
