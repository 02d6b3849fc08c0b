"""Per-key results although few keys hold much of the data.

Value-frequency compression: rows are grouped by key *and value* first, so the shuffle that spreads the work hashes on the
pair and a key holding a third of all rows is spread over as many tasks as it has values. Distinct counts, modes, sums and
percentiles then come exactly from the weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str | Sequence[str], weight: str | None = None) -> DataFrame:
    """One row per key and value with its ``freq``. Null keys and null values are kept as such; a caller filters them.

    An empty input gives an empty result. Columns other than those named are ignored.
    """
    values = [value] if isinstance(value, str) else list(value)
    return df.groupBy(*keys, *values).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("freq"))


def value_bucket(value: Column, per_octave: int = 16) -> Column:
    """A bucket number that never falls as the value rises; at most ~2048 * per_octave of them for any doubles."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * per_octave)).cast("long")


def weighted_percentiles(freqs: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact percentiles (linear interpolation) per key from weighted values; one row per key.

    A key's values are cut into value buckets, whose number is bounded whatever the data; a rank is found from the
    buckets' totals and the running weight inside one bucket. No task holds a whole key.
    Null and NaN values do not count; a key with no other values gives no row.
    """
    keys = list(keys)
    rows = freqs.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_bucket", value_bucket(F.col(value)))
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("freq").alias("_in_bucket"))
    by_key = Window.partitionBy(*keys)
    named = [*keys, "_bucket"]
    bases = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(named)],
        F.coalesce(F.sum("_in_bucket").over(by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_in_bucket").over(by_key).alias("_n"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(named)]
    ranked = (
        rows.join(bases, same)
        .select(*named, value, "freq", "_base", "_n")
        .withColumn("_end", F.col("_base") + F.sum("freq").over(Window.partitionBy(*keys, "_bucket").orderBy(value)))
        .withColumn("_start", F.col("_end") - F.col("freq"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col(value)))

    out = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_n") - 1)
        low, high = at(F.floor(position)), at(F.ceil(position))
        out.append((low + (high - low) * F.max(position - F.floor(position))).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def key_statistics(df: DataFrame, key: str, value: str, probabilities: dict[str, float]) -> DataFrame:
    """Per key: rows, sum of the value, distinct values, the mode (smallest of the most frequent) and exact percentiles.

    NULL is no key. Null and NaN values count as rows only. Ties for the mode go to the smallest value.
    """
    v = F.when(~F.isnan(value), F.col(value))
    freqs = value_frequencies(df.where(F.col(key).isNotNull()).select(key, v.alias("_value")), [key], "_value")
    known = F.col("_value").isNotNull()
    summary = freqs.groupBy(key).agg(
        F.sum("freq").alias("n_rows"),
        F.sum(F.col("_value") * F.col("freq")).alias("total"),
        F.count("_value").alias("n_distinct"),
        F.max(F.when(known, F.struct("freq", (-F.col("_value")).alias("least")))).alias("_mode"),
    )
    percentiles = weighted_percentiles(freqs, [key], "_value", probabilities)
    return summary.join(percentiles, key, "left").withColumn("mode", -F.col("_mode.least")).drop("_mode")


def heavy_keys(df: DataFrame, keys: dict[str, str], value: str, *, percent: int) -> DataFrame:
    """(key_kind, key_name, n) of the keys that hold at least ``percent`` % of all distinct values.

    ``keys``: the kind's name by key column. Rows with a null value do not count; a null key is no key, but its values
    count in the total. All kinds are counted over one grouping by keys and value.
    """
    freqs = value_frequencies(df.where(F.col(value).isNotNull()), list(keys), value)
    return df.sparkSession.sql(
        f"""
        WITH counted AS (
          SELECT {', '.join(keys)}, grouping_id() AS gid, count(1) AS n
          FROM {{freqs}} GROUP BY GROUPING SETS ({', '.join(f'({k})' for k in keys)}, ())
        ), named AS (
          SELECT CASE {' '.join(f"WHEN gid = {_gid(i, len(keys))} THEN '{kind}'" for i, kind in enumerate(keys.values()))} END AS key_kind,
                 coalesce({', '.join(keys)}) AS key_name, n, gid FROM counted
        )
        SELECT key_kind, key_name, n FROM named
        WHERE key_kind IS NOT NULL AND key_name IS NOT NULL
          AND n * 100 >= {percent} * (SELECT max(n) FROM named WHERE gid = {2 ** len(keys) - 1})
        """,
        freqs=freqs,
    )


def _gid(i: int, n: int) -> int:
    """grouping_id() of the set that holds only the i-th of n columns."""
    return (2**n - 1) - 2 ** (n - 1 - i)
