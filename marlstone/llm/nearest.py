"""Matching records by nearest time: tick expansion, then an equi-join on entity and tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    entity: Column,
    left_id: str,
    left_us: Column,
    right_id: str,
    right_us: Column,
    tolerance_us: int,
    tick_us: int | None = None,
    right_entity: Column | None = None,
) -> DataFrame:
    """Each left record with the right record of its entity nearest in time, before or after, at most ``tolerance_us`` away.

    Right records are reduced to one an instant, and every tick that holds some is exploded to the ticks within tolerance,
    its last instant to those after it and its first to those before it. Of these an entity-tick keeps the nearest on
    either side, and left records join it on entity and tick. Times need not be as coarse as ticks: instants inside a left
    record's own tick are ordered with it, by a sort that spills, so that the result is exact at any tick length and no tick
    is ever held as an array. ``tick_us`` is a fifth of the tolerance by default: 10 rows for a tick that holds records,
    however many it holds, and an entity with a third of all rows is spread over its ticks.

    Ties: of two equally near the earlier, of several at one instant the smallest id. Copies count once. Records with a
    null id, entity or time take no part; a left record without a partner gives no row.
    Result: left_id, right_id, gap_us (right minus left).
    """
    tick = tick_us or -(-tolerance_us // 5)
    reach = -(-tolerance_us // tick)
    named = right.select((right_entity if right_entity is not None else entity).alias("_e"), right_us.alias("_us"), F.col(right_id).alias("_id")).where("_e IS NOT NULL AND _us IS NOT NULL AND _id IS NOT NULL")
    at = F.floor(F.col("_us") / tick).cast("long").alias("_tick")
    instants = named.groupBy("_e", "_us").agg(F.min("_id").alias("_id"))

    edges = named.groupBy("_e", at).agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    spread = edges.withColumn("_off", F.explode(F.array(*[F.lit(i) for i in range(-reach, reach + 1) if i]))).withColumn("_tick", F.col("_tick") + F.col("_off"))
    ahead, behind = F.col("_off") > 0, F.col("_off") < 0
    # a tick further from the instant than the tolerance can't be matched from it
    spread = spread.where((ahead & (F.col("_tick") * tick - F.col("_last") <= tolerance_us)) | (behind & (F.col("_first") - (F.col("_tick") + 1) * tick < tolerance_us)))
    around = spread.groupBy("_e", "_tick").agg(F.max(F.when(ahead, F.col("_last"))).alias("_before"), F.min(F.when(behind, F.col("_first"))).alias("_after"))

    asked = left.select(entity.alias("_e"), left_us.alias("_us"), F.col(left_id).alias("_left")).where("_e IS NOT NULL AND _us IS NOT NULL AND _left IS NOT NULL")
    kind = dict(asked.dtypes)["_left"]
    merged = asked.unionByName(named.select("_e", "_us", F.lit(None).cast(kind).alias("_left"))).withColumn("_tick", at).repartition("_e", "_tick")
    w = Window.partitionBy("_e", "_tick")
    up, down = (w.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("_us"), F.desc("_us")))  # both in one pass over sorted rows
    own = F.when(F.col("_left").isNull(), F.col("_us"))
    inside = merged.select(
        "_e", "_tick", F.col("_us").alias("_t"), "_left", F.max(own).over(up).alias("_low"), F.min(own).over(down).alias("_high")
    ).where("_left IS NOT NULL")

    t = F.col("_t")
    found = inside.join(around, ["_e", "_tick"], "left").select("_e", "_t", "_left", F.greatest("_low", "_before").alias("_low"), F.least("_high", "_after").alias("_high"))
    earlier = F.col("_high").isNull() | (t - F.col("_low") <= F.col("_high") - t)
    found = found.withColumn("_us", F.when(F.col("_low").isNotNull() & earlier, F.col("_low")).otherwise(F.col("_high"))).where(F.abs(F.col("_us") - t) <= tolerance_us)
    out = found.select("_e", "_us", "_t", "_left").distinct().join(instants, ["_e", "_us"])
    return out.select(F.col("_left").alias(left_id), F.col("_id").alias(right_id), (F.col("_us") - t).alias("gap_us"))
