"""Ranks and running values without an unpartitioned window.

A group may hold most of the rows (one sample pair, or a grand mean over everything), so no group
is sorted in one task. Rows are range-partitioned by (group, order), the slice number is written
with them, each slice is scanned on its own and the small table of slice totals gives the offsets.
Input must hold one row per (group, order value): ties are counted beforehand, so a hot value is
one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquant.lineage import cut

SLICE = "_slice"


def sliced(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Range-partition by (by, order) and keep the partition number as a column.

    The number of slices is left to adaptive execution, which joins neighbouring ranges only.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in by], F.col(order))
    return cut(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def running(slices: DataFrame, by: Sequence[str], order: str, value: Column, kind: str, out: str) -> DataFrame:
    """Add a running ``sum`` or ``max`` in ascending order, or a ``min`` from the far end."""
    by = list(by)
    backward = kind == "min"
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
    valued = slices.withColumn("_value", value)
    totals = valued.groupBy(*by, SLICE).agg(agg("_value").alias("_total"))
    # At most one row per group and slice, so this window is as small as the partition count.
    earlier = Window.partitionBy(*by).orderBy(F.col(SLICE).desc() if backward else F.col(SLICE).asc())
    offsets = totals.withColumn("_offset", agg("_total").over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy(*by, SLICE).orderBy(F.col(order).desc() if backward else F.col(order).asc())
    local = agg("_value").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    combined = {
        "sum": F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0)),
        "max": F.greatest(F.col("_local"), F.col("_offset")),
        "min": F.least(F.col("_local"), F.col("_offset")),
    }[kind]
    return (
        valued.withColumn("_local", local)
        .join(offsets.drop("_total"), [*by, SLICE])
        .withColumn(out, combined)
        .drop("_value", "_local", "_offset")
    )


def with_totals(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add per-group totals; without groups the single row comes in as scalar subqueries."""
    if by:
        return df.join(totals, list(by))
    return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})


def grouped_median(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median of each group: equal values are counted, then the middle ones are picked."""
    by = list(by)
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running(sliced(counted, by, value), by, value, F.col("_n"), "sum", "_upto")
    totals = df.groupBy(*by).agg(F.count("*").alias("_total"))
    joined = with_totals(ranked, totals, by)
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    first, last = F.col("_upto") - F.col("_n") + 1, F.col("_upto")
    holds = lambda rank: (rank >= first) & (rank <= last)
    middle = joined.groupBy(*by).agg(
        F.max(F.when(holds(low), F.col(value))).alias("_low"), F.max(F.when(holds(high), F.col(value))).alias("_high")
    )
    return middle.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias(out))
