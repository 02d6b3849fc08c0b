"""Features of a prediction grid from event streams: imbalances, persistence, rates, quotes and activity against a baseline.

A grid has (key, us) and an id; a stream (key, us) and columns. Calendar windows are [t - width, t), event windows the last n
stream events strictly before t. Both come from sums: trailing ones by bucket, and prefix sums joined at event numbers, so
that no window's events are ever gathered. A window without events gives NULL, never 0.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import buckets
from marlstone.sources.tables import finite

EPSILON = 1e-9


def calendar_sums(grid: DataFrame, stream: DataFrame, key: str, us: str, grid_id: str, sums: dict[str, Column], windows: dict[str, int]) -> DataFrame:
    """``grid`` ids with, per window, ``n_<window>`` and ``<sum>_<window>``: NULL sums where no event has a value."""
    values = stream.select(key, us, F.lit(None).cast(dict(grid.dtypes)[grid_id]).alias(grid_id), F.lit(1).alias("_event"), *[c.cast("double").alias(f"_s_{n}") for n, c in sums.items()])
    asks = grid.select(key, us, grid_id, F.lit(None).cast("int").alias("_event"), *[F.lit(None).cast("double").alias(f"_s_{n}") for n in sums])
    rows = values.where(F.col(key).isNotNull() & F.col(us).isNotNull()).unionByName(asks)
    for name, width in windows.items():
        made = lambda w, name=name: {f"n_{name}": F.count("_event").over(w), **{f"{n}_{name}": F.sum(f"_s_{n}").over(w) for n in sums}}
        rows = buckets.trailing(rows, key, us, width, made)
    return rows.where("_event IS NULL").drop("_event", *[f"_s_{n}" for n in sums])


def event_sums(grid: DataFrame, stream: DataFrame, key: str, us: str, grid_id: str, sums: dict[str, Column], tie: Sequence[str], counts: Sequence[int], marks: Sequence[str] = ()) -> DataFrame:
    """``grid`` ids with, per n, ``n_last_<n>`` (events there are, at most n) and ``<sum>_last_<n>``, and ``marks`` of the last event.

    Sums are over values, null ones adding 0; NULL only where there is no event. A grid row is placed once among the stream
    to find the number of its last event and joined once for each n.
    """
    events = stream.where(F.col(key).isNotNull() & F.col(us).isNotNull()).select(key, us, *dict.fromkeys([*tie, *marks]), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_s_{n}") for n, c in sums.items()])
    events = buckets.numbered(events, key, us, tie, {f"_p_{n}": F.col(f"_s_{n}") for n in sums})
    return _at_numbers(grid, events, key, us, grid_id, list(sums), counts, marks)


def _at_numbers(grid: DataFrame, events: DataFrame, key: str, us: str, grid_id: str, sums: Sequence[str], counts: Sequence[int], marks: Sequence[str]) -> DataFrame:
    """``event_sums`` of events that have their numbers (_row) and prefix sums (_p_<sum>)."""
    mark = F.struct("_row", *[F.col(f"_p_{n}") for n in sums], *marks)
    tagged = events.select(key, us, mark.alias("_mark"), F.lit(None).cast(dict(grid.dtypes)[grid_id]).alias(grid_id))
    asks = grid.select(key, us, F.lit(None).cast(tagged.schema["_mark"].dataType).alias("_mark"), grid_id).withColumn("_ask", F.lit(True))
    found = buckets.known(tagged.withColumn("_ask", F.lit(False)).unionByName(asks), key, us, F.col("_mark"), name="_last").where("_ask")
    out = found.select(key, us, grid_id, F.col("_last._row").alias("_at"), *[F.col(f"_last._p_{n}").alias(f"_e_{n}") for n in sums], *[F.col(f"_last.{m}").alias(f"last_{m}") for m in marks])
    for n in counts:
        back = events.select(F.col(key).alias("_k"), F.col("_row").alias("_r"), *[F.col(f"_p_{s}").alias(f"_b_{s}") for s in sums])
        out = out.join(back, (F.col(key) == F.col("_k")) & (F.col("_at") - n == F.col("_r")), "left")
        out = out.withColumns({f"n_last_{n}": F.least(F.coalesce("_at", F.lit(0)), F.lit(n)), **{f"{s}_last_{n}": F.col(f"_e_{s}") - F.coalesce(f"_b_{s}", F.lit(0.0)) for s in sums}})
        out = out.drop("_k", "_r", *[f"_b_{s}" for s in sums])
    return out.drop("_at", *[f"_e_{s}" for s in sums])


def transformed(size: Column, kind: str) -> Column:
    """A size as it is, its log(1 + x) or its root; negative ones count as 0 there."""
    return {"raw": size, "log": F.log1p(F.greatest(size, F.lit(0.0))), "sqrt": F.sqrt(F.greatest(size, F.lit(0.0)))}[kind]


def side_sums(side: str, size: Column | None = None, name: str = "") -> dict[str, Column]:
    """Buys and sells, or their sizes, as sums for the windows above."""
    value = F.lit(1.0) if size is None else size
    return {f"buy{name}": F.when(F.col(side) == 1, value), f"sell{name}": F.when(F.col(side) == -1, value)}


def imbalance(buy: Column, sell: Column, buy_weight: float = 1.0, sell_weight: float = 1.0, epsilon: float = EPSILON) -> Column:
    """(buys - sells) / (buys + sells + epsilon), each side weighted; NULL without either."""
    b, s = F.coalesce(buy, F.lit(0.0)) * buy_weight, F.coalesce(sell, F.lit(0.0)) * sell_weight
    return F.when(b + s > 0, (b - s) / (b + s + epsilon))


def side_weights(stream: DataFrame, us: str, side: str, measures: dict[str, Column], train_end: int | None = None) -> DataFrame:
    """Per measure: the weights total / (2 * side's total) that make both sides count alike, from rows strictly before
    ``train_end``; 1 and 1 where a side is absent. Negative values count as 0."""
    rows = stream.where(F.col(side).isin(-1, 1))
    rows = rows if train_end is None else rows.where(F.col(us) < train_end)
    total = lambda s, c: F.coalesce(F.sum(F.when(F.col(side) == s, F.greatest(c.cast("double"), F.lit(0.0)))), F.lit(0.0))
    one = rows.agg(F.array(*[F.struct(F.lit(m).alias("measure"), total(1, c).alias("buy_total"), total(-1, c).alias("sell_total")) for m, c in measures.items()]).alias("_m")).select(F.inline("_m"))
    whole, both = F.col("buy_total") + F.col("sell_total"), (F.col("buy_total") > 0) & (F.col("sell_total") > 0)
    weight = lambda c: F.when(both, whole / (2 * F.col(c))).otherwise(F.lit(1.0))
    return one.select("measure", "buy_total", "sell_total", weight("buy_total").alias("buy_weight"), weight("sell_total").alias("sell_weight"), F.when(both, "inverse_market_share").otherwise("symmetric_fallback").alias("method"))


def persistence(grid: DataFrame, stream: DataFrame, key: str, us: str, grid_id: str, side: str, tie: Sequence[str], counts: Sequence[int], epsilon: float = EPSILON) -> DataFrame:
    """Of the sided events before each grid row: the last side, the length of its run, seconds since the last event of the
    other side, and per n the share of the last n on the last side and the switches among them over n - 1."""
    events = stream.where(F.col(side).isin(-1, 1) & F.col(key).isNotNull() & F.col(us).isNotNull()).select(key, us, side, *tie)
    events = buckets.numbered(events, key, us, tie, before=F.struct(side, us)).drop("_prior")
    switched = F.coalesce(F.col("_lag")[side] != F.col(side), F.lit(False))
    # where a run begins, its first row and the time of the other side's last event are known; later rows carry them
    begun = F.when(F.col("_lag").isNull() | switched, F.struct(F.col("_row").alias("row"), F.col("_lag")[us].alias("other")))
    events = events.withColumns({"_begun": begun, "_s_buy": (F.col(side) == 1).cast("double"), "_s_sell": (F.col(side) == -1).cast("double"), "_s_switch": switched.cast("double")})
    names = ["buy", "sell", "switch"]
    events = buckets.chain(
        buckets.placed(events, key, us), key, {**{f"_t_{n}": F.sum(f"_s_{n}") for n in names}, "_t_run": F.max("_begun")},
        lambda w: {**{f"_c_{n}": F.sum(f"_t_{n}").over(w) for n in names}, "_c_run": F.max("_t_run").over(w)},
    )
    order = Window.partitionBy(key, "_bucket").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    run = F.coalesce(F.max("_begun").over(order), F.col("_c_run"))
    events = events.withColumns({**{f"_p_{n}": F.coalesce(f"_c_{n}", F.lit(0.0)) + F.sum(f"_s_{n}").over(order) for n in names}, "run": F.col("_row") - run["row"] + 1, "other_us": run["other"]})
    out = _at_numbers(grid, events, key, us, grid_id, names, [*counts, *[n - 1 for n in counts]], marks=(side, "run", "other_us"))
    last = F.col(f"last_{side}")
    columns = [last.alias("last_side"), F.col("last_run").alias("same_side_run_length"), ((F.col(us) - F.col("last_other_us")) / 1e6).alias("elapsed_seconds_since_side_change")]
    for n in counts:
        same = F.when(last == 1, F.col(f"buy_last_{n}")).otherwise(F.col(f"sell_last_{n}"))
        columns.append(F.when(last.isNotNull(), same / F.col(f"n_last_{n}")).alias(f"fraction_same_last_{n}"))
        # among m events there are m - 1 steps: the switches of all but the first of them
        switches = F.when(F.col(f"n_last_{n}") < n, F.col(f"switch_last_{n}")).otherwise(F.col(f"switch_last_{n - 1}"))
        columns.append(F.when(F.col(f"n_last_{n}") > 1, switches / (F.col(f"n_last_{n}") - 1 + epsilon)).alias(f"switching_hazard_last_{n}"))
    return out.select(grid_id, *columns)


def quote_state(grid: DataFrame, quotes: DataFrame, key: str, us: str, grid_id: str, epsilon: float = EPSILON) -> DataFrame:
    """The last quote strictly before each grid row: spread, mid, asymmetry of bid and ask around mid, and staleness in seconds.

    Of several at one instant the one with the largest (bid, ask, mid, spread) counts.
    """
    rows = quotes.where(F.col(key).isNotNull() & F.col(us).isNotNull()).select(key, us, F.struct(F.col(us).alias("t"), "bid", "ask", "mid", "spread").alias("_q"), F.lit(None).cast(dict(grid.dtypes)[grid_id]).alias(grid_id), F.lit(False).alias("_ask"))
    asks = grid.select(key, us, F.lit(None).cast(rows.schema["_q"].dataType).alias("_q"), grid_id, F.lit(True).alias("_ask"))
    found = buckets.known(rows.unionByName(asks), key, us, F.col("_q"), name="_last").where("_ask")
    q = F.col("_last")
    lean = F.when((q["mid"] != 0) & q["bid"].isNotNull() & q["ask"].isNotNull(), (q["ask"] + q["bid"] - 2 * q["mid"]) / (F.abs(q["mid"]) + epsilon))
    return found.select(grid_id, q["spread"].alias("spread"), q["mid"].alias("mid"), lean.alias("asymmetry"), ((F.col(us) - q["t"]) / 1e6).alias("staleness_seconds"))


def rate_sums(flags: dict[str, Column]) -> dict[str, Column]:
    """A flag's positives and its known rows, as sums: their ratio is a rate that leaves out rows where it is null."""
    return {k: v for name, c in flags.items() for k, v in ((f"{name}_yes", c.cast("double")), (f"{name}_known", c.isNotNull().cast("double")))}


def rate(name: str, window: str, epsilon: float = EPSILON) -> Column:
    known = F.col(f"{name}_known_{window}")
    return F.when(known > 0, F.coalesce(F.col(f"{name}_yes_{window}"), F.lit(0.0)) / (known + epsilon))


def baseline(train: DataFrame, value: str, levels: Sequence[Sequence[str]], least: int) -> DataFrame:
    """Mean, deviation and count of ``value`` at every pooling level, by one grouping of sets, after winsorising at the 1st and
    99th percentile of all training values. Level numbers rise from the finest; groups under ``least`` rows are left out."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    low, high = train.where(F.col(value).isNotNull()).agg(F.percentile(value, 0.01), F.percentile(value, 0.99)).first()
    clipped = train.where(F.col(value).isNotNull()).withColumn("_v", F.greatest(F.least(F.col(value), F.lit(high)), F.lit(low)))
    spark, sets = train.sparkSession, ", ".join(f"({', '.join(level)})" for level in levels)
    bits = lambda level: sum(2 ** (len(names) - 1 - i) for i, c in enumerate(names) if c not in level)
    number = " ".join(f"WHEN {bits(level)} THEN {i}" for i, level in enumerate(levels))
    return spark.sql(
        f"""SELECT {', '.join(names)}, CASE gid {number} END AS level, expected, CASE WHEN n = 1 THEN abs(expected) WHEN s IS NULL OR s <= 0 THEN 1D ELSE s END AS scale, n FROM (
          SELECT {', '.join(names)}, grouping_id({', '.join(names)}) AS gid, avg(_v) AS expected, stddev_samp(_v) AS s, count(1) AS n FROM {{rows}} GROUP BY GROUPING SETS ({sets})) WHERE n >= {least}""",
        rows=clipped,
    )


def surprise(rows: DataFrame, value: str, base: DataFrame, levels: Sequence[Sequence[str]], epsilon: float = EPSILON) -> DataFrame:
    """``rows`` with ``expected``, ``scale`` and ``surprise``: (value - expected) / (|scale| + epsilon) by the finest level that
    has the row's group. A null group value matches none."""
    out = rows
    for i, level in enumerate(levels):
        part = base.where(F.col("level") == i).select(*level, F.struct("expected", "scale").alias(f"_l{i}"))
        out = out.join(part, list(level), "left") if level else out.withColumn(f"_l{i}", F.lit(None).cast("struct<expected:double,scale:double>"))
    best = F.coalesce(*[F.col(f"_l{i}") for i in range(len(levels))])
    out = out.withColumns({"expected": best["expected"], "scale": best["scale"]}).drop(*[f"_l{i}" for i in range(len(levels))])
    return out.withColumn("surprise", (F.col(value) - F.col("expected")) / (F.abs("scale") + epsilon))


def micros_of(t: dt.datetime) -> int:
    return int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def clean(c: str) -> Column:
    return finite(F.col(c).cast("double"))
