"""Signals stored as JSON lines, one event object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import fingerprint, is_object, parse_iso
from rillflow.schemas import EVENT_SCHEMA_VERSION, SIGNAL_COLUMNS

_FIELDS = (
    "id", "source", "source_instance", "kind", "title", "content", "author", "url",
    "created_at", "updated_at", "collected_at",
)


def signals_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Event objects with the defaults for what older writers left out; without a collection time, the creation time."""
    read = lines.select(F.try_parse_json(column).alias("v"))
    named = read.select(
        *[F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in _FIELDS],
        F.try_variant_get("v", "$.schema_version", "int").alias("schema_version"),
        F.to_json(F.try_variant_get("v", "$.metadata", "variant")).alias("metadata_json"),
    )
    filled = named.select(
        "id",
        F.coalesce("schema_version", F.lit(EVENT_SCHEMA_VERSION)).alias("schema_version"),
        "source",
        F.coalesce("source_instance", F.lit("default")).alias("source_instance"),
        "kind", "title",
        F.coalesce("content", F.lit("")).alias("content"),
        "author", "url",
        parse_iso(F.col("created_at")).alias("created_at"),
        parse_iso(F.col("updated_at")).alias("updated_at"),
        F.coalesce(parse_iso(F.col("collected_at")), parse_iso(F.col("created_at"))).alias("collected_at"),
        F.coalesce("metadata_json", F.lit("{}")).alias("metadata_json"),
    )
    return filled.withColumn("event_hash", fingerprint()).select(*SIGNAL_COLUMNS)


def parse_archive(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Signals of the good lines, and ``(line, message)`` of those that hold no event; blank lines hold nothing."""
    v = F.try_parse_json(column)
    ident = F.coalesce(F.trim(F.try_variant_get(v, "$.id", "string")), F.lit(""))
    flaw = (
        F.when(v.isNull(), "the line is no JSON").when(~is_object(v), "the line is JSON but no object")
        .when(ident == "", "the event has no id")
    )
    checked = lines.filter(F.trim(column) != "").withColumn("_flaw", flaw)
    problems = checked.filter("_flaw IS NOT NULL").select(F.col(column).alias("line"), F.col("_flaw").alias("message"))
    return signals_from_json(checked.filter("_flaw IS NULL").select(column), column), problems


def read_signals_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Signals of a folder of JSON lines, and the lines that are none."""
    return parse_archive(spark.read.text(path))


def get_signals(signals: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored rows of many ids at once."""
    return signals.join(ids.select("id").distinct(), "id", "left_semi")


def get_signal(signals: DataFrame, event_id: str) -> DataFrame:
    return signals.filter(F.col("id") == event_id)


def exists(signals: DataFrame, ids: DataFrame) -> DataFrame:
    """Each asked id once, with whether it is stored."""
    asked = ids.select("id").distinct()
    stored = signals.join(asked, "id", "left_semi").select("id").distinct()
    return asked.join(stored.withColumn("stored", F.lit(True)), "id", "left").select(
        "id", F.coalesce("stored", F.lit(False)).alias("stored")
    )


def count(signals: DataFrame) -> DataFrame:
    return signals.agg(F.count("*").alias("signals_total"))
