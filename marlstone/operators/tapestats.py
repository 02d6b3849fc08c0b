"""Statistics of a tape: prints against their bond's own sizes, volume clocks, runs, forward prices and similarity of tapes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import buckets
from marlstone.operators.skew import value_frequencies, weighted_percentiles

EPSILON = 1e-9


def with_percentiles(df: DataFrame, key: str, value: str, probabilities: dict[str, float]) -> DataFrame:
    """``df`` with its key's exact percentiles over all rows, from weighted values, so that no task holds a key."""
    stats = weighted_percentiles(value_frequencies(df.where(F.col(key).isNotNull()), [key], value), [key], value, probabilities)
    return df.join(stats, key, "left")


def large_print_pressure(df: DataFrame, key: str, size: str, side: str) -> DataFrame:
    """``df`` with ``pressure``: against the side of prints of at least the bond's 90th percentile, by the root of their size
    over its median, up to 5; 0 for other prints. Percentiles are of the whole sample."""
    rows = with_percentiles(df, key, size, {"_mid": 0.5, "_high": 0.9})
    scale = F.least(F.sqrt(F.col(size) / F.greatest("_mid", F.lit(EPSILON))), F.lit(5.0))
    return rows.withColumn("pressure", F.when(F.col(size) >= F.col("_high"), -F.col(side) * scale).otherwise(F.when(F.col(size).isNotNull(), F.lit(0.0)))).drop("_mid", "_high")


def robust_z(df: DataFrame, value: str, name: str = "z") -> DataFrame:
    """(value - median) / (1.4826 MAD) over all rows, by the deviation where the MAD is 0, 0 where that is too."""
    one = lambda rows, v: rows.groupBy(F.lit(0).alias("_g"), v.alias("_v")).agg(F.count(F.lit(1)).alias("freq"))
    mid = weighted_percentiles(one(df, F.col(value)), ["_g"], "_v", {"_mid": 0.5})
    spread = df.agg(F.stddev_samp(value).alias("_s")).withColumn("_g", F.lit(0))
    rows = df.withColumn("_g", F.lit(0)).join(F.broadcast(mid.join(spread, "_g")), "_g")  # one row
    mad = weighted_percentiles(one(rows, F.abs(F.col(value) - F.col("_mid"))), ["_g"], "_v", {"_mad": 0.5})
    scale = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise(F.col("_s"))
    return rows.join(F.broadcast(mad), "_g").withColumn(name, F.when(scale > 0, (F.col(value) - F.col("_mid")) / scale).otherwise(F.lit(0.0))).drop("_g", "_mid", "_s", "_mad")


def forward(df: DataFrame, key: str, us: str, tie: Sequence[str], columns: Sequence[str], steps: Sequence[int]) -> DataFrame:
    """``df`` with ``<column>_<k>``: the value k rows later in the key's history, joined at row numbers; NULL at the end."""
    rows = buckets.numbered(df, key, us, tie).drop("_prior")
    out = rows
    for k in steps:
        later = rows.select(F.col(key).alias("_k"), (F.col("_row") - k).alias("_r"), *[F.col(c).alias(f"{c}_{k}") for c in columns])
        out = out.join(later, (F.col(key) == F.col("_k")) & (F.col("_row") == F.col("_r")), "left").drop("_k", "_r")
    return out.drop("_row")


def first_at_or_after(df: DataFrame, key: str, us: str, value: str, horizon_us: int, tie: Sequence[str], name: str = "future") -> DataFrame:
    """``df`` with the value of the key's first row at or after its own time plus the horizon; of one instant the first by ``tie``."""
    first = df.groupBy(key, us).agg(F.min(F.struct(*tie, value)).alias("_f")).select(key, us, F.struct(F.col(f"_f.{value}").alias("v")).alias("_mark"))
    asks = df.withColumns({"_own": F.col(us), us: F.col(us) + horizon_us})
    merged = asks.withColumn("_ask", F.lit(True)).unionByName(first.withColumn("_ask", F.lit(False)), allowMissingColumns=True)
    found = buckets.known(merged, key, us, F.col("_mark"), strict=False, forward=True, name="_next").where("_ask")
    return found.withColumns({us: F.col("_own"), name: F.col("_next.v")}).drop("_own", "_ask", "_mark", "_next")


def volume_buckets(df: DataFrame, key: str, us: str, size: str, side: str, tie: Sequence[str], volume: float) -> DataFrame:
    """(key, bucket, buy, sell, last_us): the tape cut into buckets of equal volume, a trade that overflows being split among
    all buckets it reaches. Only full buckets come out. Sizes that are null or not above 0 add nothing."""
    rows = df.where((F.col(size) > 0) & F.col(key).isNotNull()).select(key, us, *tie, F.col(size).alias("_v"), F.col(side).alias("_s"))
    rows = buckets.numbered(rows, key, us, tie, {"_end": F.col("_v").cast("decimal(24,6)")}).withColumn("_end", F.col("_end").cast("double"))
    begin = F.col("_end") - F.col("_v")
    rows = rows.withColumn("bucket", F.explode(F.sequence(F.floor(begin / volume).cast("long"), F.greatest(F.ceil(F.col("_end") / volume).cast("long") - 1, F.floor(begin / volume).cast("long")))))
    part = F.least(F.col("_end"), (F.col("bucket") + 1) * volume) - F.greatest(begin, F.col("bucket") * volume)
    out = rows.groupBy(key, "bucket").agg(F.sum(F.when(F.col("_s") == 1, part).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("_s") == -1, part).otherwise(0.0)).alias("sell"), F.max(us).alias("last_us"), F.sum(part).alias("_all"))
    return out.where(F.col("_all") >= volume * (1 - 1e-9)).drop("_all")


def vpin(cut: DataFrame, key: str, volume: float, n: int) -> DataFrame:
    """``cut`` buckets with the mean one-sidedness of the last ``n`` of them."""
    w = Window.partitionBy(key).orderBy("bucket").rowsBetween(-(n - 1), 0)
    return cut.withColumn("vpin", F.avg(F.abs(F.col("buy") - F.col("sell")) / volume).over(w))


def l1(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """One row: the summed difference of two tables' shares of ``column``, values missing on a side counting as 0 there."""
    share = lambda df, n: df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).select(column, (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias(n))
    both = share(left, "_a").join(share(right, "_b"), column, "outer")
    return both.agg(F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))).alias("l1"))


def comovement(changes: DataFrame, group: str, time: str, value: str) -> DataFrame:
    """One row: the mean correlation of pairs of groups over the times both have, from pair sums over narrow group-time rows.

    Pairs meet on time only, so their number is that of group pairs per time; ``group`` is one with few values, as issuers.
    """
    means = changes.where(F.col(value).isNotNull()).groupBy(group, time).agg(F.avg(value).alias("_v"))
    other = means.select(F.col(group).alias("_g"), F.col(time).alias("_t"), F.col("_v").alias("_w"))
    pairs = means.join(other, (F.col(time) == F.col("_t")) & (F.col(group) < F.col("_g"))).groupBy(group, "_g").agg(F.corr("_v", "_w").alias("_c"), F.count(F.lit(1)).alias("_n"))
    good = F.col("_c").isNotNull() & ~F.isnan("_c") & (F.col("_n") > 1)
    return pairs.agg(F.count(F.when(good, 1)).alias("pairs"), F.avg(F.when(good, F.col("_c"))).alias("mean_correlation"))


def sessions(spark: SparkSession, start: dt.date, n: int, holidays: Sequence[dt.date] = ()) -> DataFrame:
    """(session, number): the first ``n`` weekdays from ``start`` on that are no holidays."""
    if n <= 0:
        raise ValueError("n is above 0")
    days = spark.range(n * 7 // 5 + 4 + len(holidays) * 3).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("session"))
    days = days.where((F.weekday("session") < 5) & ~F.col("session").isin(*holidays)) if holidays else days.where(F.weekday("session") < 5)
    return days.withColumn("number", F.row_number().over(Window.orderBy("session")) - 1).where(F.col("number") < n)


def in_session(us: Column, open_minute: int = 570, close_minute: int = 960) -> Column:
    """The session date of an instant between open and close of a weekday, else NULL."""
    minute = F.floor(us / 60_000_000) % 1440
    day = F.to_date(F.timestamp_micros(us))
    return F.when((F.weekday(day) < 5) & (minute >= open_minute) & (minute <= close_minute), day)


def ensemble(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric over the rows (one a seed): median, mean, deviation (of the population), extremes, 5th and 95th percentile."""
    long = df.unpivot([], list(metrics), "metric", "v").where("v IS NOT NULL AND NOT isnan(v)")
    q = lambda p: F.percentile("v", p)
    return long.groupBy("metric").agg(
        q(0.5).alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), q(0.05).alias("p05"), q(0.95).alias("p95")
    )


def composite(scores: DataFrame, groups: Sequence[str], family: str, score: str, weights: dict[str, float], top: int | None = None) -> DataFrame:
    """Per group the weighted mean of its families' scores (weight 1 for those unlisted), its direction and its components;
    with ``top`` only the largest by size, ties by group."""
    listed = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
    w = F.coalesce(listed[F.col(family)], F.lit(1.0))
    value = F.coalesce(F.col(score), F.lit(0.0))
    out = scores.groupBy(*groups).agg(F.coalesce(F.try_divide(F.sum(w * value), F.sum(F.abs(w))), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("component_count"))
    out = out.withColumn("direction", F.when(F.col("score") > 0, "long").when(F.col("score") < 0, "short").otherwise("flat"))
    return out if top is None else out.orderBy(F.desc(F.abs("score")), *groups).limit(top)


def clipped(c: Column, limit: float = 3.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), c))
