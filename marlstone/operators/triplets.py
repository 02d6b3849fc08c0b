"""Clocks, lag-anchor-horizon panels, their rank correlations, and signals frozen at the end of training."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from marlstone.operators import buckets
from marlstone.operators.evaluation import t_survival
from marlstone.operators.skew import value_bucket

CANDIDATE = ("lag", "anchor", "horizon", "target_type")


def calendar_clock(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    """(clock_index, us): instants from start to end, e.g. every 'INTERVAL 1 DAY'."""
    ticks = spark.sql(f"SELECT posexplode(sequence(TIMESTAMP '{start}', TIMESTAMP '{end}', {step})) AS (clock_index, t)")
    return ticks.select("clock_index", F.unix_micros("t").alias("us"))


def event_clock(events: DataFrame, us: str, every: int, tie: Sequence[str]) -> DataFrame:
    """(clock_index, us): the instant of every ``every``-th event of all, numbered bucket by bucket of time."""
    if every <= 0:
        raise ValueError("every is above 0")
    rows = buckets.numbered(events.where(F.col(us).isNotNull()).withColumn("_all", F.lit(0)), "_all", us, tie)
    return rows.where(F.col("_row") % every == 0).select((F.col("_row") / every - 1).cast("int").alias("clock_index"), F.col(us).alias("us"))


def information_clock(events: DataFrame, key: str, us: str, activity: str, threshold: float, tie: Sequence[str]) -> DataFrame:
    """(key, clock_index, us): per key, a tick where the activity since the last tick reaches ``threshold``; what is beyond it
    is lost at a tick. Null activity counts as 0, negative activity is an error.

    Each key's rows come sorted and stream by in batches: the state from row to row is one number, so nothing is held, but a
    key is one task's work, as every tick depends on the one before.
    """
    if threshold <= 0:
        raise ValueError("threshold is above 0")
    amount = F.nanvl(F.coalesce(F.col(activity).cast("double"), F.lit(0.0)), F.lit(0.0))
    checked = F.when(amount < 0, F.raise_error(F.lit("negative activity")).cast("double")).otherwise(amount)
    rows = events.where(F.col(key).isNotNull() & F.col(us).isNotNull()).select(key, F.col(us).alias("us"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)], checked.alias("_a"))
    rows = rows.repartition(key).sortWithinPartitions(key, "us", *[f"_t{i}" for i in range(len(tie))]).select(key, "us", "_a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, total, ticks = None, 0.0, 0
        for batch in batches:
            out = []
            for k, t, a in zip(batch[key].tolist(), batch["us"].tolist(), batch["_a"].tolist()):
                if k != current:
                    current, total, ticks = k, 0.0, 0
                total += a
                if total >= threshold:
                    out.append((k, ticks, t))
                    total, ticks = 0.0, ticks + 1
            yield pd.DataFrame(out, columns=[key, "clock_index", "us"])

    schema = rows.select(key, F.lit(0).alias("clock_index"), "us").schema
    return rows.mapInPandas(run, schema)


def sampled(state: DataFrame, clock: DataFrame, instrument: str, us: str, value: str) -> DataFrame:
    """(instrument, clock_index, us, value): at each tick the last non-null value by then, none before an instrument's first.

    Ticks are a stated list, sent along with every instrument's name; ``clock`` may have the instrument's own ticks.
    """
    if instrument in clock.columns:
        grid = clock.select(instrument, "clock_index", F.col("us").alias(us))
    else:
        ticks = clock.agg(F.collect_list(F.struct("clock_index", F.col("us").alias(us))).alias("_ticks")).first()[0]
        ticks = F.array(*[F.struct(F.lit(t[0]).alias("clock_index"), F.lit(t[1]).cast("long").alias(us)) for t in ticks])
        grid = state.where(F.col(instrument).isNotNull()).select(instrument).distinct().select(instrument, F.inline(ticks))
    rows = state.where(F.col(value).isNotNull()).select(instrument, us, value, F.lit(None).cast("int").alias("clock_index")).unionByName(grid.withColumn(value, F.lit(None).cast("double")))
    found = buckets.known(rows, instrument, us, F.col(value), strict=False, name="_found")
    return found.where("clock_index IS NOT NULL AND _found IS NOT NULL").select(instrument, "clock_index", us, F.col("_found").alias(value))


def panel(samples: DataFrame, instrument: str, us: str, value: str, *, lags: Sequence[int], horizons: Sequence[int], anchors: Sequence[int] = (0,), duration: str | None = None) -> DataFrame:
    """One row per instrument, tick, lag, anchor and horizon: the move over the lag to the anchor and that over the horizon on.

    With ``duration`` moves are turned into price moves by -duration at the anchor (1 where unknown). Every sample emits its
    candidates; values lag and lead by rows of its instrument.
    """
    w = Window.partitionBy(instrument).orderBy("clock_index")
    at = lambda c, k: F.col(c) if k == 0 else (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w)
    scale = lambda a: F.lit(1.0) if duration is None else -F.coalesce(F.nanvl(at(duration, a), F.lit(None)), F.lit(1.0))
    made = [
        F.struct(
            at("clock_index", a).alias("clock_index"), at(us, a).alias(us), F.lit(lag).alias("lag"), F.lit(a).alias("anchor"), F.lit(h).alias("horizon"), F.lit("clean_price" if duration is None else "spread_implied").alias("target_type"),
            (scale(a) * (at(value, a) - at(value, a - lag))).alias("past_move"), (scale(a) * (at(value, a + h) - at(value, a))).alias("future_move"),
        )
        for a in anchors for lag in lags for h in horizons
    ]
    rows = samples.withColumn("_c", F.array(*made)).select(instrument, F.inline("_c"))
    return rows.where("past_move IS NOT NULL AND future_move IS NOT NULL AND NOT isnan(past_move) AND NOT isnan(future_move)")


def _mean_ranks(df: DataFrame, groups: Sequence[str], c: str, name: str) -> DataFrame:
    """``df`` with the average rank of ``c`` in its group, from counts of distinct values in value buckets."""
    freq = df.groupBy(*groups, c).agg(F.count(F.lit(1)).alias("_f")).withColumn("_b", value_bucket(F.col(c) * 1e6, 64))
    base = freq.groupBy(*groups, "_b").agg(F.sum("_f").alias("_n"))
    base = base.select(*groups, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum("_f").over(Window.partitionBy(*groups, "_b").orderBy(c))
    ranks = freq.join(base, [*groups, "_b"]).select(*groups, c, (F.col("_base") + inside - (F.col("_f") - 1) / 2).alias(name))
    return df.join(ranks, [*groups, c])


def estimates(rows: DataFrame, registry: DataFrame | None = None, groups: Sequence[str] = CANDIDATE) -> DataFrame:
    """Spearman's rho, its p-value and n_obs per candidate; fewer than three rows or a constant side give NULL and 1.

    Candidates of ``registry`` without rows stay. There are as many rows as candidates.
    """
    ranked = _mean_ranks(_mean_ranks(rows.select(*groups, "past_move", "future_move"), groups, "past_move", "_x"), groups, "future_move", "_y")
    varied = (F.count(F.lit(1)) >= 3) & (F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0)
    out = ranked.groupBy(*groups).agg(F.when(varied, F.corr("_x", "_y")).alias("rho"), F.count(F.lit(1)).alias("n_obs"))
    if registry is not None:
        out = registry.select(*groups).distinct().join(out, list(groups), "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))

    @F.pandas_udf(DoubleType())
    def p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
        def one(r: float, k: int) -> float:
            if r != r or k < 3:
                return 1.0
            return 0.0 if abs(r) >= 1 else t_survival(r * math.sqrt((k - 2) / (1 - r * r)), k - 2)

        return pd.Series([one(r, k) for r, k in zip(rho.astype(float), n)])

    return out.withColumn("p_value", p_value(F.col("rho"), F.col("n_obs")))


def adjusted(df: DataFrame, method: str = "holm", groups: Sequence[str] = CANDIDATE) -> DataFrame:
    """``adjusted_p_value`` by Holm or Benjamini-Hochberg over all candidates, which are few and ordered together."""
    p = F.greatest(F.least(F.coalesce(F.nanvl("p_value", F.lit(None)), F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
    w = Window.orderBy("_p", *groups)
    rows = df.withColumn("_p", p).withColumn("_i", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
    if method == "holm":
        value = F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col("_p"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    elif method in ("bh", "fdr_bh"):
        value = F.least(F.lit(1.0), F.min(F.col("_p") * F.col("_m") / F.col("_i")).over(Window.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        raise ValueError(f"no method {method!r}")
    return rows.withColumn("adjusted_p_value", value).drop("_p", "_i", "_m")


def selected(df: DataFrame, alpha: float = 0.05, least: int = 20) -> DataFrame:
    return df.withColumn("selected", (F.col("adjusted_p_value") <= alpha) & (F.col("n_obs") >= least) & F.col("rho").isNotNull())


@F.pandas_udf(DoubleType())
def normal_score(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return p.map(lambda x: None if x is None or x != x else inverse(min(max(x, 1e-6), 1 - 1e-6)))


def scores(rows: DataFrame, chosen: DataFrame, train: DataFrame, instrument: str) -> DataFrame:
    """(clock_index, instrument, lag, anchor, horizon, target_type, score) of the selected candidates: the sign of rho times the
    normal score of a move's rank among the training moves, which are counted by value bucket and joined, never collected."""
    keys = list(CANDIDATE)
    picks = chosen.where("selected").select(*keys, F.when(F.col("rho") >= 0, 1.0).otherwise(-1.0).alias("_sign"))
    # training moves and asked moves in one order per candidate and value bucket
    asked = rows.join(picks, keys).select(*keys, "_sign", "clock_index", instrument, F.col("past_move").alias("_v"), F.lit(0).alias("_one"))
    seen = train.join(picks, keys).select(*keys, "_sign", F.lit(None).cast("int").alias("clock_index"), F.lit(None).cast(dict(rows.dtypes)[instrument]).alias(instrument), F.col("past_move").alias("_v"), F.lit(1).alias("_one"))
    both = asked.unionByName(seen).withColumn("_b", value_bucket(F.col("_v") * 1e6, 64))
    base = both.groupBy(*keys, "_b").agg(F.sum("_one").alias("_n"))
    group = Window.partitionBy(*keys)
    base = base.select(*keys, "_b", F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(group).alias("_all"))
    upto = F.col("_base") + F.sum("_one").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    ranked = both.join(base, [*keys, "_b"]).withColumn("_upto", upto).where("_one = 0 AND _all > 0")
    return ranked.select("clock_index", instrument, *keys, (F.col("_sign") * normal_score((F.col("_upto") + 0.5) / (F.col("_all") + 1.0))).alias("score"))


def aggregated(df: DataFrame, instrument: str, weight: Column | None = None) -> DataFrame:
    """(clock_index, instrument, triplet_signal, component_count): the weighted mean of a tick's scores; null scores count as 0."""
    w = F.lit(1.0) if weight is None else F.coalesce(F.nanvl(weight, F.lit(None)), F.lit(0.0))
    return df.groupBy("clock_index", instrument).agg(
        F.try_divide(F.sum(w * F.coalesce("score", F.lit(0.0))), F.sum(F.abs(w))).alias("triplet_signal"), F.count(F.lit(1)).alias("component_count")
    )
