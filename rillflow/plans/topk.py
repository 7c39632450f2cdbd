"""First k rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spark keeps only k rows per key and task before the shuffle while k stays at or below this setting.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
# Tasks that share a key where k is larger; each keeps k rows of it.
SALTS = 64


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int | Column,
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """Keep the first ``k`` rows of each key and add their 1-based ``rank``.

    With a small constant the rank filter is pushed below the shuffle. A larger or per-row ``k`` is
    applied twice: within salted slices of each key, then to what the slices kept.
    """
    whole = Window.partitionBy(*keys).orderBy(*order)
    if isinstance(k, int) and k <= int(df.sparkSession.conf.get(GROUP_LIMIT)):
        return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)
    limit = F.lit(k) if isinstance(k, int) else k
    slot = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not _opaque(df, c)]), F.lit(salts))
    sliced = Window.partitionBy(*keys, "_slot").orderBy(*order)
    kept = (
        df.withColumn("_slot", slot)
        .withColumn(rank, F.row_number().over(sliced))
        .filter(F.col(rank) <= limit)
        .drop("_slot", rank)
    )
    return kept.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= limit)


def _opaque(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType.simpleString()
    return "variant" in kind or "map<" in kind
