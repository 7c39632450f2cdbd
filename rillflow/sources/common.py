"""What every normaliser shares: the item columns and the finished signal."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import fingerprint, source_key, stable_id
from rillflow.schemas import EVENT_SCHEMA_VERSION, SIGNAL_COLUMNS

# Columns of a payload that stay with each of its items.
CARRY = ("payload_id", "batch_id", "source", "source_instance", "url", "fetched_at", "page_no")
ITEM_COLUMNS = ("payload_id", "batch_id", "source_key", "page_no", "pos", "external_id")


def metadata(fields: Mapping[str, Column]) -> Column:
    """Canonical metadata text: sorted keys, compact, nulls kept."""
    return F.to_json(
        F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}
    )


def finish(
    items: DataFrame,
    *,
    kind: Column,
    title: Column,
    content: Column,
    author: Column,
    url: Column,
    created_at: Column,
    updated_at: Column,
    meta: Mapping[str, Column] | Column,
) -> DataFrame:
    """Item positions plus the fourteen signal columns, from carried columns and ``external_id``.

    The fields are fixed first and hashed in a second projection, so text is extracted once.
    """
    fields = items.select(
        "payload_id", "batch_id", "page_no", "pos", "external_id",
        source_key(F.col("source"), F.col("source_instance")).alias("source_key"),
        F.lit(EVENT_SCHEMA_VERSION).alias("schema_version"),
        "source", "source_instance",
        kind.alias("kind"), title.alias("title"), content.alias("content"),
        author.alias("author"), url.alias("url"), created_at.alias("created_at"),
        updated_at.alias("updated_at"), F.col("fetched_at").alias("collected_at"),
        (meta if isinstance(meta, Column) else metadata(meta)).alias("metadata_json"),
    )
    return fields.select(
        *ITEM_COLUMNS,
        stable_id(
            F.col("source"), F.col("external_id"), F.col("kind"), F.col("source_instance")
        ).alias("id"),
        *[c for c in SIGNAL_COLUMNS if c not in ("id", "event_hash")],
        fingerprint().alias("event_hash"),
    )


def problem(df: DataFrame, level: str, message: Column) -> DataFrame:
    """Rows of the side table that collects parse errors and warnings."""
    return df.select(
        "payload_id", "batch_id",
        source_key(F.col("source"), F.col("source_instance")).alias("source_key"),
        F.lit(level).alias("level"), message.alias("message"),
    )


def told(level: str, message: Column) -> Column:
    """One entry of the list that :func:`problems_of` takes."""
    return F.struct(F.lit(level).alias("level"), message.alias("message"))


def problems_of(df: DataFrame, *lists: Column) -> DataFrame:
    """Rows of the same side table from lists of :func:`told` entries, null where there are none.

    The lists are exploded, not filtered: a filter on what was parsed is moved below the parsing and parses
    again for each mention of its result.
    """
    none = F.array().cast("array<struct<level string, message string>>")
    every = F.concat(*[F.coalesce(x, none) for x in lists])
    key = source_key(F.col("source"), F.col("source_instance")).alias("source_key")
    rows = df.select("payload_id", "batch_id", key, F.explode_outer(every).alias("_p"))
    return rows.filter("_p IS NOT NULL").select("payload_id", "batch_id", "source_key", "_p.level", "_p.message")


def listed(condition: Column, items: Column) -> Column:
    """The places and elements of a list where the condition holds; :func:`present` drops what is left without.

    As with :func:`problems_of`, no filter asks for the condition.
    """
    return F.posexplode_outer(F.when(condition, items))


def present(rows: DataFrame) -> DataFrame:
    return rows.filter("pos IS NOT NULL")
