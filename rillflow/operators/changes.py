"""Insert, update or unchanged: comparing a batch of signals with the stored ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.plans import CHUNK, previous_value
from rillflow.schemas import SIGNAL_COLUMNS


def stored_hashes(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids and hashes of the stored rows a batch touches; two columns are read, nothing else.

    A small batch turns the semi-join into a broadcast filter on the scan.
    """
    return current.select("id", "event_hash").join(batch.select("id").distinct(), "id", "left_semi")


def classify_changes(
    batch: DataFrame,
    current: DataFrame,
    seq: str = "seq",
    carry: Sequence[str] = ("collected_at",),
    chunk: int = CHUNK,
) -> DataFrame:
    """``change`` of each batch row, in order of the integer ``seq``, which is unique per id.

    A row is compared with the row before it, the first of an id with the stored one. An id with a
    large part of the batch is cut by ``seq``, so it never forms a single task. Only ``id``, ``seq``,
    the hash and the ``carry`` columns are shuffled and returned; contents stay where they are.
    """
    narrow = batch.select("id", seq, "event_hash", *[c for c in carry if c not in ("id", seq, "event_hash")])
    seen = previous_value(
        narrow, ["id"], seq, "event_hash", "_before", stored_hashes(current, batch), chunk
    )
    return seen.withColumn(
        "change",
        F.when(F.col("_before").isNull(), "inserted")
        .when(F.col("_before") == F.col("event_hash"), "unchanged")
        .otherwise("updated"),
    ).drop("_before")


def write_counts(changes: DataFrame, *keys: str) -> DataFrame:
    """Inserted, updated, unchanged and changed rows, per key if any are named."""
    return changes.groupBy(*keys).agg(
        F.count_if(F.col("change") == "inserted").alias("inserted"),
        F.count_if(F.col("change") == "updated").alias("updated"),
        F.count_if(F.col("change") == "unchanged").alias("unchanged"),
        F.count_if(F.col("change") != "unchanged").alias("changed"),
    )


def last_versions(batch: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """The full row each changed id ends up with: the last that was no repeat of its predecessor.

    The winning ``seq`` per id is a hash aggregate over two columns; full rows move once, to meet it.
    """
    winners = (
        changes.filter(F.col("change") != "unchanged").groupBy("id").agg(F.max(seq).alias(seq))
    )
    return batch.join(winners, ["id", seq], "left_semi").select(*SIGNAL_COLUMNS)


def apply_changes(
    current: DataFrame, batch: DataFrame, changes: DataFrame, seq: str = "seq"
) -> DataFrame:
    """The stored table after the batch. Unchanged ids keep their row with its old ``collected_at``."""
    touched = changes.filter(F.col("change") != "unchanged").select("id").distinct()
    kept = current.select(*SIGNAL_COLUMNS).join(touched, "id", "left_anti")
    return kept.select(*SIGNAL_COLUMNS).unionByName(last_versions(batch, changes, seq))
