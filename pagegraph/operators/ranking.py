"""First-per-key and top-k-per-key without pulling a whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], newest: bool = False) -> DataFrame:
    """Row with the smallest (or greatest) ``order`` per key.

    One aggregation with map-side combine: a hot key costs one partial row per map task.
    """
    rest = [name for name in df.columns if name not in keys]
    pick = F.max_by if newest else F.min_by
    best = pick(F.struct(*[F.col(name) for name in rest]), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: int = 64
) -> DataFrame:
    """At most ``k`` rows per key in ``order``; exact, whatever the key sizes.

    Each key is first cut to ``k`` rows in ``spread`` independent slices of its rows, so a key
    that holds a third of the table is sorted by many tasks; the last step sees at most
    ``k * spread`` rows of a key.
    """
    if k <= 0:
        return df.limit(0)
    slice_of = F.pmod(F.xxhash64(*[F.col(name) for name in df.columns]), F.lit(spread))
    sliced = df.withColumn("_slice", slice_of)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    return (
        sliced.withColumn("_rank", F.row_number().over(local))
        .where(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(overall))
        .where(F.col("_rank") <= k)
        .drop("_rank", "_slice")
    )


def newest_first(df: DataFrame, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Global order with an optional limit (sort plus limit becomes one take-ordered step)."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)
