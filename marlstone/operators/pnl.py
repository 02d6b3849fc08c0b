"""Profit and loss: expressions on rows, and curves and summaries by group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_pnl(quantity: Column, entry: Column, exit: Column, cost: Column | float = 0.0) -> Column:
    return quantity * (exit - entry) - cost


def spread_pnl(quantity: Column, dv01: Column, entry: Column, exit: Column, cost: Column | float = 0.0) -> Column:
    """A long position loses where the spread widens."""
    return -quantity * dv01 * (exit - entry) - cost


def marked_value(cash: Column, position: Column, mark: Column) -> Column:
    return cash + position * mark


def marked_pnl(cash: Column, position: Column, mark: Column, start: Column | float = 0.0) -> Column:
    return marked_value(cash, position, mark) - start


def signed_exposure(quantity: Column, mark: Column) -> Column:
    return quantity * mark


def gross_exposure(quantity: Column, mark: Column) -> Column:
    return F.abs(quantity * mark)


def by_day(df: DataFrame, pnl: str, time: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups, F.to_date(time).alias("day")).agg(F.sum(pnl).alias(pnl))


def curve(df: DataFrame, pnl: str, order: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with equity (running sum), drawdown (from the running peak of equity) and runup (from its running trough).

    Meant for one row a group and day: without groups the days themselves are ordered in one task.
    """
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("equity", F.when(F.col(pnl).isNotNull(), F.sum(pnl).over(w)))
    return out.withColumn("drawdown", F.col("equity") - F.max("equity").over(w)).withColumn("runup", F.col("equity") - F.min("equity").over(w))


def summary(df: DataFrame, pnl: str, order: Sequence[str], groups: Sequence[str] = (), annualization: float | None = None) -> DataFrame:
    """Per group: count, total, mean, volatility, Sharpe-like ratio, profit factor, win rate, greatest drawdown and runup.

    Null rows do not count. A ratio without variation, and volatility of fewer than two rows, are NULL; the profit factor
    without losses is infinite with gains and NULL without; rows at 0 are neither won nor lost.
    """
    x, root = F.col(pnl), math.sqrt(annualization or 1.0)
    rows = curve(df.where(x.isNotNull()), pnl, order, groups)
    n, vol = F.count(x), F.when(F.count(x) > 1, F.stddev_samp(x))
    gains, losses = F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, -x).otherwise(0.0))
    factor = F.when(losses > 0, gains / losses).when(gains > 0, F.lit(float("inf")))
    return rows.groupBy(*groups).agg(
        n.alias("count"), F.sum(x).alias("total_pnl"), F.avg(x).alias("mean_pnl"), (vol * root).alias("volatility"), (F.try_divide(F.avg(x), vol) * root).alias("sharpe_like_ratio"),
        factor.alias("profit_factor"), F.avg(F.when(x != 0, (x > 0).cast("double"))).alias("win_rate"), F.min("drawdown").alias("max_drawdown"), F.max("runup").alias("max_runup"),
    )
