"""Table verification: layout, integrity and orphans."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.schemas import (
    DELIVERY_STATUSES, HEALTH_STATUSES, KINDS, LAYOUT_VERSION, PRIMARY_KEYS, REQUIRED, TABLES,
)

_ENUMS = {
    ("signals", "kind"): KINDS,
    ("deliveries", "status"): DELIVERY_STATUSES,
    ("source_health", "status"): HEALTH_STATUSES,
}


def layout_status(schemas: Mapping[str, T.StructType], version: int) -> tuple[str, str | None]:
    """``current``, ``migration_required``, ``future`` or ``invalid``, with what is wrong."""
    if version < LAYOUT_VERSION:
        return "migration_required", None
    if version > LAYOUT_VERSION:
        return "future", f"layout version {version} is newer than supported version {LAYOUT_VERSION}"
    absent = sorted(set(TABLES) - set(schemas))
    if absent:
        return "invalid", "missing tables: " + ", ".join(absent)
    for name, wanted in TABLES.items():
        lacking = sorted(set(wanted.fieldNames()) - set(schemas[name].fieldNames()))
        if lacking:
            return "invalid", f"table {name} is missing columns: {', '.join(lacking)}"
    return "current", None


def _counted(name: str, df: DataFrame) -> DataFrame:
    """Bad rows per check of one table.

    The table is read once and grouped by its key; rows of a key are combined per task first, so a
    repeated key costs no more than any other.
    """
    rules = [(f"{name}.{c} not null", F.col(c).isNull()) for c in REQUIRED[name]]
    rules += [
        (f"{name}.{c} known value", ~F.coalesce(F.col(c).isin(*values), F.lit(False)))
        for (t, c), values in _ENUMS.items() if t == name
    ]
    per_key = df.groupBy(*PRIMARY_KEYS[name]).agg(
        F.count("*").alias("n"), *[F.count_if(bad).alias(f"c{i}") for i, (_, bad) in enumerate(rules)]
    )
    totals = per_key.agg(
        F.count_if(F.col("n") > 1).alias("repeated"),
        *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(rules))],
    )
    checks = [(f"{name} primary key unique", F.col("repeated"))]
    checks += [(check, F.col(f"c{i}")) for i, (check, _) in enumerate(rules)]
    return totals.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("check"), n.alias("bad")) for c, n in checks])
        ).alias("r")
    ).select("r.*")


def integrity(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check with the number of bad rows and pass, warn or fail."""
    parts = [_counted(name, df) for name, df in tables.items()]
    if "deliveries" in tables and "signals" in tables:
        lost = orphans(tables["deliveries"], tables["signals"])
        parts.append(
            lost.agg(F.count("*").alias("bad")).select(F.lit("deliveries have their event").alias("check"), "bad")
        )
    merged = reduce(DataFrame.unionByName, parts)
    # A lost event is repaired by the next delivery pass, so it only warns.
    soft = F.col("check") == "deliveries have their event"
    return merged.withColumn(
        "status", F.when(F.col("bad") == 0, "pass").when(soft, "warn").otherwise("fail")
    )


def orphans(deliveries: DataFrame, signals: DataFrame) -> DataFrame:
    """Deliveries whose event is gone."""
    ids = signals.select(F.col("id").alias("event_id"))
    return deliveries.join(ids, "event_id", "left_anti").select("sink_key", "event_id")
