"""The late-event aggregates and the change replay as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.late import HOUR_US, LATENESS_HOURS


def hourly_totals(trades: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Trades and notional per bond and hour of event time, from a stream (or table) of ``trace_trades`` rows.

    What counts is told by arrival, as in the batch: a trade's receive_time, else publication_time, must lie before its
    hour's end plus ``LATENESS_HOURS``. ``lateness`` only says how long state is kept: an hour is dropped once a trade that counts
    is of an hour more than that past its end, so nothing in time is lost while rows come in order of arrival and none arrives before its event.
    Copies of a trade count once. Rows without id, bond, event time or arrival are left out; null or NaN notional adds 0.
    In append mode an hour comes out once closed, in update mode with every correction.
    """
    begin = F.floor(F.unix_micros(F.col("source_event_time").cast("timestamp")) / HOUR_US).cast("long") * HOUR_US
    arrival = F.unix_micros(F.coalesce("receive_time", "publication_time").cast("timestamp"))
    rows = trades.where("bond_id IS NOT NULL AND source_event_time IS NOT NULL AND trade_id IS NOT NULL").where(arrival < begin + (1 + LATENESS_HOURS) * HOUR_US).withColumn("hour", F.timestamp_micros(begin))
    if rows.isStreaming:
        rows = rows.withWatermark("hour", f"{lateness} 60 minutes")  # an hour is named by its start
    amount = F.coalesce(F.nanvl("notional", F.lit(0.0)), F.lit(0.0))
    once = rows.dropDuplicates(["trade_id", "bond_id", "source_event_time", "notional", "hour"])
    return once.groupBy("bond_id", "hour").agg(F.count(F.lit(1)).alias("n_trades"), F.sum(amount).alias("notional"))


def apply_changes(state: DataFrame, batch: DataFrame, **columns) -> DataFrame:
    """One micro-batch of a change feed applied to ``state``, for foreachBatch.

    ``state`` and ``batch`` both hold changes: the state is kept as the last removal and the last set of every key, in
    the feed's own form, so that batches may come in any order and more than once.
    """
    from marlstone.operators.replay import compacted

    return compacted(state.unionByName(batch), **columns)
