"""Windows over (key, bucket of time) in place of whole keys.

A window partitioned by a key puts all of the key's history into one task. Here rows are placed by key and bucket: trailing
windows see the rows that reach over from the bucket before, and whatever needs all of the history (last values, numbers and
sums of rows) is chained from bucket to bucket by one row each. A key with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY = 86_400_000_000


def bucket(us: str, width: int = DAY) -> Column:
    return F.floor(F.col(us) / width).cast("long")


def trailing(df: DataFrame, key: str, us: str, width: int, columns: Callable[[WindowSpec], dict[str, Column]], *, strict: bool = True, ahead: bool = False) -> DataFrame:
    """``df`` with ``columns`` of the window [t - width, t), or [t - width, t] where not ``strict``; ``ahead``: (t, t + width].

    Rows near a bucket's edge are seen from the next bucket too, but come out once. A null key is a key of its own.
    """
    return seen(df, key, us, width, lambda rows, w: rows.withColumns(columns(w)), strict=strict, ahead=ahead)


def seen(df: DataFrame, key: str, us: str, width: int, made: Callable[[DataFrame, WindowSpec], DataFrame], *, strict: bool = True, ahead: bool = False) -> DataFrame:
    """``trailing`` for what needs more than columns: ``made`` gets the placed rows and the window."""
    size = max(width, DAY)
    own = bucket(us, size)
    if ahead:
        reach = F.when(F.col(us) - own * size <= width, F.array(own, own - 1)).otherwise(F.array(own))
        frame = (1 if strict else 0, width)
    else:
        reach = F.when((own + 1) * size - F.col(us) <= width, F.array(own, own + 1)).otherwise(F.array(own))
        frame = (-width, -1 if strict else 0)
    rows = df.withColumn("_home", own).withColumn("_bucket", F.explode(reach))
    out = made(rows, Window.partitionBy(key, "_bucket").orderBy(us).rangeBetween(*frame))
    return out.where("_home = _bucket").drop("_home", "_bucket")


def summed(df: DataFrame, keep: Sequence[str], key: str, us: str, width: int, values: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` with each of ``values``, which are integers, summed over [t - width, t); 0 without any, and for a
    null key or time.

    A sliding frame adds up its rows anew for every instant. Here each row comes in at its instant and goes out ``width``
    later, and one running total makes all windows of a bucket. In a bucket as wide as the window exactly the rows of the
    bucket before go out, so it begins with their total and waits for no other bucket.
    """
    placed = F.col(key).isNotNull() & F.col(us).isNotNull()
    sign = F.explode(F.when(placed, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(0))))
    rows = df.select(*keep, F.when(placed, F.col(key)).alias("_key"), F.col(us).alias("_at"), *[v.cast("long").alias(n) for n, v in values.items()], sign.alias("_sign"))
    at, out = F.col("_at") + F.when(F.col("_sign") < 0, width).otherwise(0), F.col("_sign") < 0
    rows = rows.select(*keep, "_key", at.alias("_at"), "_sign", *[(F.col(n) * F.col("_sign")).alias(n) for n in values])
    # rows without key or time are spread, under a null key
    rows = rows.withColumn("_bucket", F.when(F.col("_sign") != 0, F.col("_at") - F.pmod("_at", F.lit(width))).otherwise(F.pmod(F.xxhash64(*keep), F.lit(1000))))
    order = Window.partitionBy("_key", "_bucket").orderBy("_at")
    before, whole = order.rangeBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({n: F.coalesce(F.sum(n).over(before), F.lit(0)) - F.sum(F.when(out, F.col(n)).otherwise(0)).over(whole) for n in values})
    return rows.where("_sign >= 0").select(*keep, *values)


def chain(df: DataFrame, key: str, totals: dict[str, Column], chained: Callable[[WindowSpec], dict[str, Column]], *, back: bool = False) -> DataFrame:
    """``df``, placed by key and ``_bucket``, with columns made from the ``totals`` of its key's earlier (``back``: later) buckets."""
    w = Window.partitionBy("_chain_key").orderBy(F.desc("_chain_at") if back else F.asc("_chain_at")).rowsBetween(Window.unboundedPreceding, -1)
    made = chained(w)
    per = df.groupBy(F.col(key).alias("_chain_key"), F.col("_bucket").alias("_chain_at")).agg(*[c.alias(n) for n, c in totals.items()])
    per = per.select("_chain_key", "_chain_at", *[c.alias(n) for n, c in made.items()])
    return df.join(per, F.col(key).eqNullSafe(F.col("_chain_key")) & (F.col("_bucket") == F.col("_chain_at"))).drop("_chain_key", "_chain_at")


def placed(df: DataFrame, key: str, us: str, width: int = DAY) -> DataFrame:
    return df.withColumn("_bucket", bucket(us, width)).repartition(key, "_bucket")


def numbered(df: DataFrame, key: str, us: str, tie: Sequence[str], sums: dict[str, Column] | None = None, width: int = DAY, before: Column | None = None) -> DataFrame:
    """``df`` with ``_row`` (its number in the key's history, from 1), ``_prior`` (rows at strictly earlier instants) and
    running sums over the history up to and with the row; with ``before`` also ``_lag``, that struct of the row before."""
    sums = sums or {}
    tail = {"_tail": F.max(F.struct(F.col(us).alias("t"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(tie)], before.alias("b")))} if before is not None else {}
    own = Window.partitionBy(key, "_bucket")
    order = own.orderBy(us, *tie)
    zero = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    rows = chain(
        placed(df, key, us, width), key, {"_n": F.count(F.lit(1)), **{f"_s_{n}": F.sum(c) for n, c in zero.items()}, **tail},
        lambda w: {"_before": F.coalesce(F.sum("_n").over(w), F.lit(0)), **{f"_b_{n}": F.sum(f"_s_{n}").over(w) for n in sums}, **({"_last": F.last("_tail").over(w)} if tail else {})},
    )
    made = {
        "_row": F.col("_before") + F.row_number().over(order),
        "_prior": F.col("_before") + F.count(F.lit(1)).over(own.orderBy(us).rangeBetween(Window.unboundedPreceding, -1)),
        **{n: F.coalesce(f"_b_{n}", F.lit(0)) + F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for n, c in zero.items()},
    }
    if tail:
        made["_lag"] = F.coalesce(F.lag(before).over(order), F.col("_last.b"))
    return rows.withColumns(made).drop("_bucket", "_before", "_last", *[f"_b_{n}" for n in sums])


def known(df: DataFrame, key: str, us: str, mark: Column, *, strict: bool = True, forward: bool = False, name: str = "_known", width: int = DAY) -> DataFrame:
    """``df`` with the latest non-null ``mark`` of its key at earlier rows (``strict``: at strictly earlier instants), or the
    earliest at later ones where ``forward``. Of several at one instant the largest."""
    rows = placed(df.withColumn("_m", F.when(mark.isNotNull(), F.struct(F.col(us).alias("t"), mark.alias("m")))), key, us, width)
    if forward:
        rows = rows.withColumn("_m", F.when(F.col("_m").isNotNull(), F.struct((-F.col("_m.t")).alias("t"), F.col("_m.m").alias("m"))))
    rows = chain(rows, key, {"_tail": F.max("_m")}, lambda w: {"_carry": F.last("_tail", ignorenulls=True).over(w)}, back=forward)
    order = F.desc(us) if forward else F.asc(us)
    inside = F.max("_m").over(Window.partitionBy(key, "_bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, -1 if strict else 0))
    return rows.withColumn(name, F.coalesce(inside, F.col("_carry"))["m"]).drop("_m", "_bucket", "_carry")
