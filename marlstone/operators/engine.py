"""Point-in-time state: features of keys at given instants, over windows of several clocks, with corrections as of then.

A record is visible from its own time until the next operation on its id, so corrections "as of t" are an interval, found
by one window over each id. An instant asked (``as_ofs``: a short stated list) is met by the records visible then: they
emit it themselves, so nothing is joined to find them. Event clocks keep the newest records by two rounds of ranking, the
first within slices of a group, and the notional clock prunes whole days by their totals first; a scope that holds a third
of all rows, or all of them, never meets in one task before it is reduced.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which events the event clocks count; fixed values.
CLOCK_TYPES = {
    "rfq_event": ("rfq_inquiry", "rfq_response", "firm_up", "rfq_execution"),
    "trade_event": ("trace_trade", "rfq_execution"),
    "composite_update": ("composite_snapshot",),
}
SCOPES = {"bond": "bond_id", "issuer": "issuer_id", "sector": "sector", "rating": "rating", "market": None}
DAY = dt.timedelta(days=1)
SLICES = 32


@dataclass(frozen=True)
class Feature:
    """One feature. ``clock``: 'calendar' (``size`` a duration of business time), 'rfq_event', 'trade_event',
    'composite_update' (``size`` a number of events) or 'notional' (``size`` an amount, the crossing event included)."""

    name: str
    operator: str
    clock: str = "calendar"
    size: dt.timedelta | float = DAY
    value: str = "notional"
    weight: str = "notional"
    scope: str = "bond"
    event_types: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    quantile: float = 0.5
    half_life_seconds: float = 3600.0
    window_seconds: float | None = None
    predicted: str | None = None
    baseline_mean: str | None = None
    baseline_std: str | None = None


def business(day: dt.date, holidays: frozenset[dt.date]) -> bool:
    return day.weekday() < 5 and day not in holidays


def back_in_business(t: dt.datetime, delta: dt.timedelta, holidays: frozenset[dt.date] = frozenset()) -> dt.datetime:
    """``t`` less ``delta`` of business time. Whole days go to the midnight that begins the last of as many sessions, today's
    counting if it is one; other spans leave out the time of days without business."""
    midnight = dt.datetime.combine(t.date(), dt.time())
    if delta >= DAY and delta % DAY == dt.timedelta(0):
        left = delta // DAY
        while True:
            left -= business(midnight.date(), holidays)
            if left == 0:
                return midnight
            midnight -= DAY
    while delta > dt.timedelta(0):
        open_ = business((t - dt.timedelta(microseconds=1)).date(), holidays)
        begin = dt.datetime.combine((t - dt.timedelta(microseconds=1)).date(), dt.time())
        if open_ and t - begin >= delta:
            return t - delta
        delta -= (t - begin) if open_ else dt.timedelta(0)
        t = begin
    return t


def known_at(events: DataFrame, policy: str = "effective") -> Column:
    """The time from which an event may be used: its effective time, or, by 'publication', when it was published, if told."""
    effective = F.coalesce("effective_time", "event_timestamp")
    return F.unix_micros(effective if policy == "effective" else F.coalesce("publication_time", effective))


def ingested(events: DataFrame, *, duplicates: str = "keep_last") -> DataFrame:
    """Upserts of one event_id once: the first or last by (time, sequence), or an error where ``duplicates`` is 'reject'. Other actions pass."""
    if duplicates not in ("keep_first", "keep_last", "reject"):
        raise ValueError(f"no policy {duplicates!r}")
    if duplicates == "keep_last":
        return events
    rows = events.withColumn("_us", known_at(events)).withColumn("_up", ~F.coalesce(F.lower(F.trim("action")).isin("cancel", "correction"), F.lit(False)))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("event_id", "_up").orderBy("_us", "sequence")))
    if duplicates == "reject":
        repeated = F.raise_error(F.concat(F.lit("repeated event_id "), F.col("event_id"))).cast("boolean")
        return rows.where(F.when(F.col("_up") & (F.col("_r") > 1), repeated).otherwise(F.lit(True))).drop("_us", "_up", "_r")
    return rows.where(~F.col("_up") | (F.col("_r") == 1)).drop("_us", "_up", "_r")


def visible(events: DataFrame, policy: str = "effective") -> DataFrame:
    """Sets of events with the interval [_us, _until) of instants at which they are the state of their id.

    Operations on an id are ordered by (time, sequence, event_id). Repeated deliveries of a sequence count once. Rows
    without a time or sequence are left out; actions compare without case and blanks, null is an upsert.
    """
    verb = F.coalesce(F.lower(F.trim("action")), F.lit("upsert"))
    rows = events.withColumn("_us", known_at(events, policy)).where("_us IS NOT NULL AND sequence IS NOT NULL").withColumn("_verb", verb)
    rows = rows.dropDuplicates(["event_id", "sequence", "corrected_event_id", "_verb"])
    struct = lambda when, name, kind: F.when(when, F.struct(name.alias("id"), F.lit(kind).alias("kind")))
    ops = F.array(
        struct(F.col("_verb") == "cancel", F.coalesce("corrected_event_id", "event_id"), 0), struct(F.col("_verb") == "correction", F.col("corrected_event_id"), 0),
        struct(F.col("_verb") != "cancel", F.col("event_id"), 1),
    )
    rows = rows.withColumn("_op", F.explode(F.filter(ops, lambda o: o["id"].isNotNull()))).withColumns({"_id": F.col("_op.id"), "_kind": F.col("_op.kind")})
    after = F.lead("_us").over(Window.partitionBy("_id").orderBy("_us", "sequence", "_kind"))
    return rows.withColumn("_until", after).where("_kind = 1 AND (_until IS NULL OR _until > _us)").drop("_verb", "_op", "_kind", "_id")


def snapshot(
    events: DataFrame, features: Sequence[Feature], as_ofs: Sequence[dt.datetime], *, keys: DataFrame | None = None, policy: str = "effective",
    holidays: frozenset[dt.date] = frozenset(), stale_after: float | None = None,
) -> DataFrame:
    """One row per key, instant and feature: key, as_of_us, feature_name, value, observation_count, effective_sample_size,
    last_us, staleness_seconds, quality_flags.

    ``keys`` (one column, ``key``) are by default the bonds with a visible event at the instant. A window without events
    gives a row with a null value and the flags no_observations and missing_value. ``active_from`` and ``active_until``,
    where the events have them, bound what a key may use and flag instants outside as outside_universe.
    """
    us = lambda t: int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    state = visible(events, policy)
    times = F.array(*[F.lit(us(t)).cast("long") for t in as_ofs])
    shown = state.withColumn("_t", F.explode(F.filter(times, lambda t: (t >= F.col("_us")) & (F.col("_until").isNull() | (t < F.col("_until"))))))
    if keys is None:
        asked = shown.where("bond_id IS NOT NULL").select(F.col("bond_id").alias("key"), "_t").distinct()
    else:
        asked = keys.select("key").distinct().withColumn("_t", F.explode(times))
    out = None
    for feature in features:
        starts = {us(t): us(back_in_business(t, feature.size, holidays)) for t in as_ofs} if feature.clock == "calendar" else {}
        part = _values(_window(shown, feature, starts), feature)
        grid = asked if feature.scope != "market" else asked.select("_t", "key")
        joined = grid.join(part, ["key", "_t"], "left") if feature.scope != "market" else grid.join(part.drop("key"), "_t", "left")
        if feature.operator in ("count", "signed_count", "intensity", "run_length"):
            joined = joined.withColumn("value", F.coalesce("value", F.lit(0.0)))
        joined = joined.withColumn("feature_name", F.lit(feature.name))
        out = joined if out is None else out.unionByName(joined)
    n, last = F.coalesce("n", F.lit(0)), F.col("_last")
    stale = (F.col("_t") - last) / 1e6
    flags = [F.when(n == 0, "no_observations"), F.when(F.col("value").isNull(), "missing_value"), F.col("_flag")]
    if stale_after is not None:
        flags.append(F.when(stale > stale_after, "stale"))
    if {"active_from", "active_until"} <= set(events.columns):
        spans = events.groupBy(F.col("bond_id").alias("key")).agg(F.unix_micros(F.min("active_from")).alias("_from"), F.unix_micros(F.max("active_until")).alias("_to"))
        out = out.join(spans, "key", "left")
        flags.append(F.when((F.col("_t") < F.col("_from")) | (F.col("_t") >= F.col("_to")), "outside_universe"))
    return out.select(
        "key", F.col("_t").alias("as_of_us"), "feature_name", "value", n.alias("observation_count"), n.cast("double").alias("effective_sample_size"), last.alias("last_us"),
        stale.alias("staleness_seconds"), F.filter(F.array_distinct(F.array(*flags)), lambda f: f.isNotNull()).alias("quality_flags"),
    )


def _window(shown: DataFrame, feature: Feature, starts: dict[int, int]) -> DataFrame:
    """The events in each key's and instant's window, as observations (key, _t, _us, _o, _s, _v, _w)."""
    types = feature.event_types or CLOCK_TYPES.get(feature.clock, ())
    if feature.event_types and feature.clock in CLOCK_TYPES:
        types = tuple(t for t in feature.event_types if t in CLOCK_TYPES[feature.clock])
    rows = shown
    if types:
        rows = rows.where(F.col("event_type").isin(*types))
    if feature.sources:
        rows = rows.where(F.col("source").isin(*feature.sources))
    for name, inside in (("active_from", lambda c: F.col("_t") >= c), ("active_until", lambda c: F.col("_t") < c)):
        if name in rows.columns:
            rows = rows.where(F.col(name).isNull() | inside(F.unix_micros(name)))
    scope = SCOPES[feature.scope]
    # an issuer's key is also met by a bond of that name
    key = F.lit("market") if scope is None else F.explode(F.array_distinct(F.filter(F.array("issuer_id", "bond_id"), lambda k: k.isNotNull()))) if feature.scope == "issuer" else F.col(scope)
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    rows = rows.select(
        key.alias("key"), "_t", "_us", F.struct("_us", "sequence", "event_id").alias("_o"), F.when(F.col("side").isin(-1, 1), F.col("side")).alias("_s"),
        number(feature.value).alias("_v"), number(feature.weight).alias("_w"), F.abs(F.coalesce(number("notional"), F.lit(0.0))).alias("_size"),
        *[(number(c) if c else F.lit(None).cast("double")).alias(n) for n, c in (("_p", feature.predicted), ("_bm", feature.baseline_mean), ("_bs", feature.baseline_std))],
    ).where("key IS NOT NULL")
    newest = F.desc("_o")
    if feature.clock == "calendar":
        begin = F.create_map(*[F.lit(x) for t, b in starts.items() for x in (t, b)])
        return rows.where(F.col("_us") >= begin[F.col("_t")])
    if feature.clock in CLOCK_TYPES:
        rank = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy("key", "_t", *by).orderBy(newest))).where(F.col("_r") <= int(feature.size)).drop("_r")
        return rank(rank(rows.withColumn("_slice", F.pmod(F.xxhash64("_o"), F.lit(SLICES))), "_slice"), ).drop("_slice")
    if feature.clock != "notional":
        raise ValueError(f"no clock {feature.clock!r}")
    day = F.floor(F.col("_us") / 86_400_000_000).alias("_day")
    later = F.coalesce(F.sum("_sum").over(Window.partitionBy("key", "_t").orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    days = rows.groupBy("key", "_t", day).agg(F.sum("_size").alias("_sum")).withColumn("_later", later).where(F.col("_later") < feature.size).drop("_sum")
    rows = rows.withColumn("_day", day).join(days, ["key", "_t", "_day"])
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy("key", "_t", "_day").orderBy(newest).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("_after", F.col("_later") + inside).where(F.col("_after") < feature.size).drop("_day", "_later", "_after")


def _values(rows: DataFrame, f: Feature) -> DataFrame:
    """(key, _t, n, value, _last, _flag) by the feature's operator."""
    v, s, w = F.col("_v"), F.col("_s"), F.col("_w")
    n, known = F.count(F.lit(1)), F.count("_v")
    flag = F.lit(None).cast("string")
    heavy = F.when((w > 0) & v.isNotNull(), w)
    first = F.min(F.when(v.isNotNull(), F.struct("_o", v.alias("v"))))["v"]
    newest = F.max(F.when(v.isNotNull(), F.struct("_o", v.alias("v"))))["v"]
    simple = {
        "count": n, "signed_count": F.coalesce(F.sum("_s"), F.lit(0)), "sum": F.sum(v), "signed_sum": F.sum(v * s), "mean": F.avg(v), "weighted_mean": F.try_divide(F.sum(v * heavy), F.sum(heavy)),
        "vwap": F.try_divide(F.sum(v * heavy), F.sum(heavy)), "min": F.min(v), "max": F.max(v), "first": first, "last": newest, "percentile": F.percentile(v, f.quantile),
        "std": F.when(known > 1, F.stddev_samp(v)), "time_since_last_event": (F.first("_t") - F.max("_us")) / 1e6,
    }
    if f.operator == "intensity":
        seconds = f.window_seconds or (f.size.total_seconds() if isinstance(f.size, dt.timedelta) else 0)
        if seconds <= 0:
            raise ValueError("an intensity needs window_seconds")
        simple["intensity"] = n / seconds
    if f.operator == "ewma":
        decay = F.pow(F.lit(2.0), -F.greatest((F.col("_t") - F.col("_us")) / 1e6, F.lit(0.0)) / f.half_life_seconds)
        simple["ewma"] = F.try_divide(F.sum(F.when(v.isNotNull(), decay * v)), F.sum(F.when(v.isNotNull(), decay)))
    if f.operator in ("residual", "time_of_day_zscore"):
        # of the newest event, whether or not it has a value
        at = F.max(F.struct("_o", "_v", "_p", "_bm", "_bs"))
        if f.operator == "residual":
            simple["residual"] = at["_v"] - at["_p"]
            flag = F.when(at["_v"].isNull() | at["_p"].isNull(), "missing_prediction")
        else:
            simple["time_of_day_zscore"] = F.when(at["_bs"] > 0, (at["_v"] - at["_bm"]) / at["_bs"])
            flag = F.when(at["_v"].isNull() | at["_bm"].isNull() | at["_bs"].isNull(), "missing_baseline").when(at["_bs"] <= 0, "zero_baseline_std")
    if f.operator in simple:
        if f.operator == "signed_count":
            flag = F.when(F.count("_s") < n, "missing_side")
        return rows.groupBy("key", "_t").agg(n.alias("n"), simple[f.operator].cast("double").alias("value"), F.max("_us").alias("_last"), flag.alias("_flag"))
    # what needs the middle of a window first: by a second aggregation over the same keys, not by arrays
    middle = rows.groupBy("key", "_t").agg(F.percentile(v, 0.5).alias("_mid"), F.max(F.when(v.isNotNull(), F.struct("_o", v.alias("v"))))["v"].alias("_newest"))
    near = rows.join(middle, ["key", "_t"])
    if f.operator == "mad":
        value = F.percentile(F.abs(v - F.col("_mid")), 0.5)
    elif f.operator in ("rolling_rank", "cross_sectional_rank"):
        value = F.try_divide(F.sum((v <= F.col("_newest")).cast("int")) - F.lit(0.5), known)
    elif f.operator == "run_length":
        order = Window.partitionBy("key", "_t").orderBy(F.desc("_o"))
        sided = rows.where("_s IS NOT NULL").withColumn("_newest", F.first("_s").over(order)).withColumn("_turned", F.max((F.col("_s") != F.col("_newest")).cast("int")).over(order))
        runs = sided.groupBy("key", "_t").agg(F.sum(F.when(F.col("_turned") == 0, F.col("_s"))).cast("double").alias("value"))
        sizes = rows.groupBy("key", "_t").agg(n.alias("n"), F.max("_us").alias("_last"), flag.alias("_flag"))
        return sizes.join(runs, ["key", "_t"], "left").select("key", "_t", "n", F.coalesce("value", F.lit(0.0)).alias("value"), "_last", "_flag")
    else:
        raise ValueError(f"no operator {f.operator!r}")
    return near.groupBy("key", "_t").agg(n.alias("n"), value.cast("double").alias("value"), F.max("_us").alias("_last"), flag.alias("_flag"))
