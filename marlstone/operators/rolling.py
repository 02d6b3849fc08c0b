"""Rolling totals over trailing periods, also for days without activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, record_id: str, *columns: Column | str) -> DataFrame:
    """Distinct records: copies agree on ``columns``. Rows without an id are no records."""
    return df.where(F.col(record_id).isNotNull()).select(record_id, *columns).distinct()


def trailing_totals(daily: DataFrame, *, entity: str, day: str, amount: str, count: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals of the trailing periods for every entity and calendar day from its first to its last day of activity.

    ``daily`` has one row per entity and day. Each row is exploded onto the days it influences, these are grouped by
    entity and day, and calendar rows give the zeros. What is exploded is one row per entity and day, never raw records,
    times the longest period: bounded per day and spread by (entity, day), so a hot entity costs no more than another.
    Rows with a null entity or day are left out; a null amount adds nothing.
    """
    daily = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(entity, day, amount, count)
    span = daily.groupBy(entity).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    calendar = span.select(entity, "_first", F.explode(F.sequence("_first", "_last")).alias(day))
    spread = daily.withColumn("_ahead", F.explode(F.sequence(F.lit(0), F.lit(max(periods) - 1)))).withColumn(day, F.date_add(day, F.col("_ahead")))
    sums = [
        F.sum(F.when(F.col("_ahead") < p, F.col(c))).alias(f"_{c}_{p}") for p in periods for c in (amount, count)
    ]
    totals = spread.groupBy(entity, day).agg(*sums)
    filled = calendar.join(totals, [entity, day], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = [F.datediff(day, "_first").alias("days_before")]
    for p in periods:
        out += [zero(f"_{amount}_{p}").alias(f"total_{p}"), zero(f"_{count}_{p}").cast("long").alias(f"count_{p}"), (zero(f"_{amount}_{p}") / p).alias(f"per_day_{p}")]
    return filled.select(entity, day, *out)
