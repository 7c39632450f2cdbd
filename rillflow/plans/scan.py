"""Ordered scans per key that no single key can overload.

A plain window puts all rows of a key into one task. Here the order column is a unique integer per
key, so an interval of ``chunk`` order values holds at most ``chunk`` rows of that key. The first
window runs inside ``(key, interval)``; only its boundary rows, or one summary row per interval,
take part in the second window over the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20


def interval(order: str, chunk: int) -> Column:
    return F.floor(F.col(order) / F.lit(chunk))


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
    before: DataFrame | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``out``: ``value`` of the row before, per key in ``order``.

    The first row of a key takes the value ``before`` (columns ``keys`` and ``value``) holds for it,
    else null. Values are never null and ``order`` is not negative. Every column of ``df`` is
    shuffled, so callers pass narrow rows.
    """
    names = df.columns
    inner = Window.partitionBy(*keys, "_interval").orderBy(order)
    marked = (
        df.withColumn("_interval", interval(order, chunk))
        .withColumn(out, F.lag(value).over(inner))
        .withColumn("_is_last", F.lead(F.lit(True)).over(inner).isNull())
    )
    inside = marked.filter(F.col(out).isNotNull()).select(*names, out)
    # First rows of an interval, the last row of every interval and what came before the key.
    ends = marked.filter(F.col(out).isNull() | F.col("_is_last")).withColumn(
        "_is_first", F.col(out).isNull()
    ).select(*names, "_is_first")
    if before is not None:
        rest = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names if c not in (*keys, order, value)]
        start = before.select(
            *keys, F.col(value), F.lit(-1).cast(df.schema[order].dataType).alias(order), *rest,
            F.lit(False).alias("_is_first"),
        )
        ends = ends.unionByName(start)
    outer = Window.partitionBy(*keys).orderBy(order)
    firsts = ends.withColumn(out, F.lag(value).over(outer)).filter("_is_first").drop("_is_first")
    return inside.unionByName(firsts)


def trailing_count(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    reset: str,
    count: str,
    out: str,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``out``: how many rows with ``count`` true follow the last ``reset`` row, itself included."""
    inner = Window.partitionBy(*keys, "_interval").orderBy(order)
    up_to = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("_interval", interval(order, chunk)).withColumn(
        "_resets", F.count_if(F.col(reset)).over(up_to)
    )
    island = Window.partitionBy(*keys, "_interval", "_resets").orderBy(order)
    local = marked.withColumn(
        "_local",
        F.count_if(F.col(count)).over(island.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    # One row per interval: did it reset, and how many counted rows trail behind.
    parts = local.groupBy(*keys, "_interval").agg(
        F.max("_resets").alias("_r"), F.max(F.struct("_resets", "_local")).alias("_t")
    )
    chain = Window.partitionBy(*keys).orderBy("_interval")
    carried = (
        parts.withColumn(
            "_group",
            F.count_if(F.col("_r") > 0).over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
        .withColumn(
            "_sum",
            F.sum("_t._local").over(
                Window.partitionBy(*keys, "_group")
                .orderBy("_interval")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn("_carry", F.coalesce(F.lag("_sum").over(chain), F.lit(0)))
        .select(*keys, "_interval", "_carry")
    )
    return (
        local.join(carried, [*keys, "_interval"], "left")
        .withColumn(
            out,
            F.col("_local") + F.when(F.col("_resets") == 0, F.coalesce("_carry", F.lit(0))).otherwise(0),
        )
        .drop("_interval", "_resets", "_local", "_carry")
    )
