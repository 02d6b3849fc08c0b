"""Attributes as known at event time: version numbers by cumulative change count, then an equi-join on the number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def as_known(
    events: DataFrame,
    attributes: DataFrame,
    *,
    key: str,
    event_id: str,
    event_us: Column,
    clocks: Sequence[Column],
    attribute_id: str,
    columns: Sequence[str] = (),
    bucket_us: int = DAY_US,
) -> DataFrame:
    """Each event with the attribute row of its key that was known at the event's time and comes last.

    ``clocks`` are microsecond columns of ``attributes`` that must all be at or before the event; of the rows known, the
    last by (clocks, attribute_id) counts. A row is known from its latest clock on. Scanned in that order within a bucket
    of time, a row is a change if it comes after all rows known before it, and changes are numbered through all buckets
    of the key. An event's number is that of the last change by then, or, where an earlier bucket knew a later row, that
    row's; wide attributes join on key and number.

    Changes and events are narrow rows in one table, shuffled once on (key, bucket), so that a key with a third of all
    rows is spread over as many tasks as it has buckets; buckets are chained by one row each. Exact copies count once.
    Rows with a null key, clock or id, and events with a null key, id or time, take no part; an event without a known
    row gives no row. Result: event_id, attribute_id, key and ``columns``; extra columns on either side are ignored.
    """
    marks = [f"_c{i}" for i in range(len(clocks))]
    facts = attributes.select(
        F.col(key).alias("_key"), *[c.alias(m) for c, m in zip(clocks, marks)], F.col(attribute_id).alias("_id"), *[F.col(c).alias(f"_w_{c}") for c in columns]
    ).where(" AND ".join(f"{c} IS NOT NULL" for c in ["_key", "_id", *marks]))
    facts = facts.withColumn("_v", F.struct(*marks, "_id"))
    known_us = F.greatest(*marks) if len(marks) > 1 else F.col(marks[0])
    asked = events.select(F.col(key).alias("_key"), event_us.alias("_us"), F.col(event_id).alias("_event")).where("_key IS NOT NULL AND _event IS NOT NULL AND _us IS NOT NULL")
    kinds = dict(facts.dtypes)["_v"], dict(asked.dtypes)["_event"]
    narrow = facts.select("_key", known_us.alias("_us"), F.lit(None).cast(kinds[1]).alias("_event"), "_v").unionByName(asked.withColumn("_v", F.lit(None).cast(kinds[0])))
    narrow = narrow.withColumn("_b", F.floor(F.col("_us") / bucket_us)).repartition("_key", "_b")
    # copies fall out inside the windows: a copy is no change, and repeated events are dropped at the end
    bucket = Window.partitionBy("_key", "_b")
    inside = bucket.orderBy("_us", F.col("_v").isNull(), "_v")  # what becomes known at an event's time is known to it
    prior = F.max("_v").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = narrow.withColumn("_prior", prior).withColumn("_change", F.col("_v").isNotNull() & (F.col("_prior").isNull() | (F.col("_v") > F.col("_prior"))))
    rows = rows.withColumn("_run", F.sum(F.col("_change").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    tops = rows.groupBy("_key", "_b").agg(F.max(F.when(F.col("_change"), F.col("_v"))).alias("_top"), F.count(F.when(F.col("_change"), 1)).alias("_n"))
    chain = Window.partitionBy("_key").orderBy("_b")
    tops = tops.withColumn("_base", F.sum("_n").over(chain) - F.col("_n"))
    last = F.when(F.col("_top").isNotNull(), F.struct("_top", (F.col("_base") + F.col("_n")).alias("number")))
    chained = tops.select("_key", "_b", "_base", F.max(last).over(chain.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    numbered = rows.join(chained, ["_key", "_b"]).withColumn("_number", F.col("_base") + F.col("_run"))
    versions = numbered.where("_change").select("_key", "_number", F.col("_v._id").alias("_id"), "_v")
    if columns:
        wide = facts.select("_key", "_v", *[f"_w_{c}" for c in columns]).dropDuplicates(["_key", "_v"])
        versions = versions.join(wide, ["_key", "_v"])
    own = F.when(F.col("_carry").isNull() | (F.col("_prior") > F.col("_carry._top")), F.col("_number")).otherwise(F.col("_carry.number"))
    found = numbered.where("_event IS NOT NULL").select("_key", own.alias("_number"), "_event").where("_number > 0").distinct()
    return found.join(versions.drop("_v"), ["_key", "_number"]).select(
        F.col("_event").alias(event_id), F.col("_id").alias(attribute_id), F.col("_key").alias(key), *[F.col(f"_w_{c}").alias(c) for c in columns]
    )
