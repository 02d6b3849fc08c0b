"""Factors of the compendium on daily bars, features of single prints, and statistics of whole tapes.

Bars are one row a bond and day, so their windows by bond are as long as there are days, whatever the trades.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import buckets
from marlstone.operators import tapestats as T
from marlstone.plans.reference import DAILY, TRADES, daily, rounded
from marlstone.sources.tables import micros, plain_id, table
from marlstone.sources.tape import trades

QUERIES, SQL = {}, {}
MOVES = DAILY + """, m AS (SELECT *, price / lag(price) OVER b - 1 AS r, price - lag(price, 2) OVER b AS d2 FROM daily WINDOW b AS (PARTITION BY bond ORDER BY day))"""


def by_bond():
    return Window.partitionBy("bond").orderBy("day")



def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def moves(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).withColumn("r", F.col("price") / F.lag("price").over(by_bond()) - 1).withColumn("d2", F.col("price") - F.lag("price", 2).over(by_bond()))


def cs_rank(c: str):
    """Share of the day's other bonds below; ties alike, nulls first as everywhere in an ascending order."""
    return F.percent_rank().over(Window.partitionBy("day").orderBy(F.col(c).asc_nulls_first()))


_CS = "percent_rank() OVER (PARTITION BY day ORDER BY {} NULLS FIRST)"


@query(
    MOVES
    + f""", v AS (SELECT *, round(volume / nullif(avg(volume) OVER w, 0), 9) AS vr, round(-r, 9) AS nr, round((price - min(price) OVER w) / (max(price) OVER w - min(price) OVER w + 1e-9), 9) AS k,
      round((price - sum(price * volume) OVER w / nullif(sum(volume) OVER w, 0)) / nullif(sum(price * volume) OVER w / nullif(sum(volume) OVER w, 0), 0), 9) AS dev, round(price - max(price) OVER w, 9) AS below, round(price - min(price) OVER w, 9) AS above,
      round(volume - lag(volume) OVER b, 4) AS dv FROM m WINDOW w AS (PARTITION BY bond ORDER BY day ROWS 9 PRECEDING), b AS (PARTITION BY bond ORDER BY day))
    SELECT bond, day, round(-dev, 7) AS vwap_reversal, round({_CS.format('vr')} * {_CS.format('nr')}, 7) AS volume_reversal, round(-{_CS.format('k')}, 7) AS range_reversal,
    round(CASE WHEN abs(dev) > 0.002 THEN -{_CS.format('below')} ELSE -{_CS.format('above')} END, 7) AS reversal_switch, round({_CS.format('dv')} - {_CS.format('dev')}, 7) AS volume_divergence FROM v"""
)
def factor_reversal(spark: SparkSession, d: str) -> DataFrame:
    """Reversal against the mean price by volume, by abnormal volume, by place in the range, switched at a distance, and of
    volume without price, over ten bars."""
    w, p, v = by_bond().rowsBetween(-9, 0), F.col("price"), F.col("volume")
    mean = F.try_divide(F.sum(p * v).over(w), F.sum(v).over(w))
    rows = moves(spark, d).withColumns(
        {
            "vr": F.round(F.try_divide(v, F.avg(v).over(w)), 9), "nr": F.round(-F.col("r"), 9), "k": F.round((p - F.min(p).over(w)) / (F.max(p).over(w) - F.min(p).over(w) + 1e-9), 9),
            "dev": F.round(F.try_divide(p - mean, mean), 9), "below": F.round(p - F.max(p).over(w), 9), "above": F.round(p - F.min(p).over(w), 9), "dv": F.round(v - F.lag(v).over(by_bond()), 4),
        }
    )
    return rows.select(
        "bond", "day", F.round(-F.col("dev"), 7).alias("vwap_reversal"), F.round(cs_rank("vr") * cs_rank("nr"), 7).alias("volume_reversal"), F.round(-cs_rank("k"), 7).alias("range_reversal"),
        F.round(F.when(F.abs("dev") > 0.002, -cs_rank("below")).otherwise(-cs_rank("above")), 7).alias("reversal_switch"), F.round(cs_rank("dv") - cs_rank("dev"), 7).alias("volume_divergence"),
    )


@query(
    MOVES
    + """, s AS (SELECT *, d2 / nullif(avg(abs(d2)) OVER w, 0) AS t, corr(price, day) OVER w AS c, count(*) OVER w AS k FROM m WINDOW w AS (PARTITION BY bond ORDER BY day ROWS 9 PRECEDING))
    SELECT bond, day, round(t, 6) AS studentised, CASE WHEN k > 2 AND NOT isnan(c) THEN round(sign(c) * c * c, 6) END AS trend_reliability FROM s"""
)
def factor_trend(spark: SparkSession, d: str) -> DataFrame:
    """Momentum over its usual size, and the sign of the trend times how much of the path it explains, over ten bars."""
    w = by_bond().rowsBetween(-9, 0)
    c = F.corr("price", "day").over(w)
    rows = moves(spark, d).withColumns({"t": F.try_divide(F.col("d2"), F.avg(F.abs("d2")).over(w)), "c": c, "k": F.count(F.lit(1)).over(w)})
    return rows.select("bond", "day", F.round("t", 6).alias("studentised"), F.round(F.when((F.col("k") > 2) & ~F.isnan("c"), F.signum("c") * F.col("c") * F.col("c")), 6).alias("trend_reliability"))


@query(
    MOVES
    + """, s AS (SELECT *, stddev_samp(r) OVER w AS vol, count(r) OVER w AS k, avg(r) OVER w AS a, avg(r * r) OVER w AS b2, avg(r * r * r) OVER w AS b3 FROM m WINDOW w AS (PARTITION BY bond ORDER BY day ROWS 19 PRECEDING)),
    t AS (SELECT *, stddev_samp(vol) OVER (PARTITION BY bond ORDER BY day ROWS 9 PRECEDING) AS vv, b2 - a * a AS q FROM s)
    SELECT bond, day, round(vol, 8) AS volatility, round(vv, 8) AS volatility_of_volatility, CASE WHEN k > 5 AND q > 1e-12 THEN round((b3 - 3 * a * b2 + 2 * a * a * a) / pow(q, 1.5), 3) END AS skewness FROM t"""
)
def factor_risk(spark: SparkSession, d: str) -> DataFrame:
    """Volatility, its own volatility, and skewness (of the population) of returns."""
    w, r = by_bond().rowsBetween(-19, 0), F.col("r")
    rows = moves(spark, d).withColumns({"vol": F.stddev_samp(r).over(w), "k": F.count(r).over(w), "a": F.avg(r).over(w), "b2": F.avg(r * r).over(w), "b3": F.avg(r * r * r).over(w)})
    rows = rows.withColumns({"vv": F.stddev_samp("vol").over(by_bond().rowsBetween(-9, 0)), "q": F.col("b2") - F.col("a") * F.col("a")})
    a = F.col("a")
    skew = F.when((F.col("k") > 5) & (F.col("q") > 1e-12), (F.col("b3") - 3 * a * F.col("b2") + 2 * a * a * a) / F.pow("q", F.lit(1.5)))
    return rows.select("bond", "day", F.round("vol", 8).alias("volatility"), F.round("vv", 8).alias("volatility_of_volatility"), F.round(skew, 3).alias("skewness"))


@query(
    MOVES
    + """, e AS (SELECT *, abs(r) / nullif(volume, 0) * 1e6 AS x FROM m), s AS (SELECT *, avg(x) OVER w AS illiquidity, x - lag(x, 2) OVER b AS velocity, x - 2 * lag(x, 2) OVER b + lag(x, 4) OVER b AS acceleration FROM e
      WINDOW w AS (PARTITION BY bond ORDER BY day ROWS 9 PRECEDING), b AS (PARTITION BY bond ORDER BY day)), t AS (SELECT *, illiquidity / (x + 1e-9) AS y FROM s)
    SELECT bond, day, round(illiquidity, 6) AS illiquidity, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, round(CASE WHEN x > 1e-6 AND lag(x, 2) OVER b > 1e-6 THEN y - lag(y, 2) OVER b END, 4) AS resilience FROM t WINDOW b AS (PARTITION BY bond ORDER BY day)"""
)
def factor_efficiency(spark: SparkSession, d: str) -> DataFrame:
    """Move per volume: its mean, velocity and acceleration, and the change of the mean over the present one."""
    rows = moves(spark, d).withColumn("x", F.try_divide(F.abs("r"), F.col("volume")) * 1e6)
    rows = rows.withColumn("illiquidity", F.avg("x").over(by_bond().rowsBetween(-9, 0))).withColumn("y", F.col("illiquidity") / (F.col("x") + 1e-9))
    x = F.col("x")
    back = F.lag(x, 2).over(by_bond())
    return rows.select(
        "bond", "day", F.round("illiquidity", 6).alias("illiquidity"), F.round(x - back, 6).alias("velocity"), F.round(x - 2 * back + F.lag(x, 4).over(by_bond()), 6).alias("acceleration"),
        F.round(F.when((x > 1e-6) & (back > 1e-6), F.col("y") - F.lag("y", 2).over(by_bond())), 4).alias("resilience"),
    )


_SIDES = {"buy": "b.side = 1", "sell": "b.side = -1"}


@query(
    TRADES
    + " SELECT a.trade_id, "
    + ", ".join(f"round(sum(b.price * b.size) FILTER ({c}) / nullif(sum(b.size) FILTER ({c} AND b.size IS NOT NULL), 0), 5) AS vwap_{n}" for n, c in _SIDES.items())
    + """, round((coalesce(sum(b.size) FILTER (b.side = 1), 0) - coalesce(sum(b.size) FILTER (b.side = -1), 0)) / nullif(sum(b.size) FILTER (b.side != 0), 0), 6) AS pressure, round(min(b.price), 6) AS low, round(max(b.price), 6) AS high,
    CAST(count(b.trade_id) AS BIGINT) AS n FROM trades a LEFT JOIN trades b ON a.bond = b.bond AND b.us >= a.us - 432000000000 AND b.us < a.us GROUP BY a.trade_id, a.bond, a.us, a.price, a.size, a.side"""
)
def factor_sides(spark: SparkSession, d: str) -> DataFrame:
    """Mean prices of buys and of sells, volume pressure and price range in the five days before each trade."""
    size = F.col("size")

    def made(w):
        of = lambda s, c: F.sum(F.when(F.col("side") == s, c)).over(w)
        buys, sells = of(1, size), of(-1, size)
        return {
            "vwap_buy": F.try_divide(of(1, F.col("price") * size), buys), "vwap_sell": F.try_divide(of(-1, F.col("price") * size), sells),
            "pressure": F.try_divide(F.coalesce(buys, F.lit(0.0)) - F.coalesce(sells, F.lit(0.0)), F.sum(F.when(F.col("side") != 0, size)).over(w)),
            "low": F.min("price").over(w), "high": F.max("price").over(w), "n": F.count(F.lit(1)).over(w),
        }

    out = buckets.trailing(trades(spark, d), "bond", "us", 5 * buckets.DAY, made)
    return out.select("trade_id", F.round("vwap_buy", 5).alias("vwap_buy"), F.round("vwap_sell", 5).alias("vwap_sell"), F.round("pressure", 6).alias("pressure"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query(
    """WITH q AS (SELECT DISTINCT upper(trim(bond_id)) AS bond, epoch_us(source_event_time) AS us, snapshot_id FROM composite_snapshots WHERE bond_id IS NOT NULL AND snapshot_id IS NOT NULL)
    SELECT a.snapshot_id, CAST(count(b.snapshot_id) AS BIGINT) AS updates FROM q a LEFT JOIN q b ON a.bond = b.bond AND b.us >= a.us - 3600000000 AND b.us < a.us GROUP BY a.snapshot_id, a.bond, a.us"""
)
def factor_quote_updates(spark: SparkSession, d: str) -> DataFrame:
    """Composites of the bond in the hour before each."""
    quotes = table(spark, d, "composite_snapshots").where("bond_id IS NOT NULL AND snapshot_id IS NOT NULL").select("snapshot_id", plain_id("bond_id").alias("bond"), micros("source_event_time").alias("us")).distinct()
    return buckets.trailing(quotes, "bond", "us", 3_600_000_000, lambda w: {"updates": F.count(F.lit(1)).over(w)}).select("snapshot_id", "updates")


@query(
    TRADES
    + """, c AS (SELECT bond, us, size, side, CAST(sum(CAST(size AS DECIMAL(24, 6))) OVER (PARTITION BY bond ORDER BY us, trade_id, price, size, side) AS DOUBLE) AS e FROM trades WHERE size > 0),
    p AS (SELECT bond, us, side, size, e, unnest(range(CAST(floor((e - size) / 1e6) AS BIGINT), greatest(CAST(ceil(e / 1e6) AS BIGINT), CAST(floor((e - size) / 1e6) AS BIGINT) + 1))) AS bucket FROM c),
    b AS (SELECT bond, bucket, sum(CASE WHEN side = 1 THEN least(e, (bucket + 1) * 1e6) - greatest(e - size, bucket * 1e6) ELSE 0 END) AS buy, sum(CASE WHEN side = -1 THEN least(e, (bucket + 1) * 1e6) - greatest(e - size, bucket * 1e6) ELSE 0 END) AS sell,
      max(us) AS last_us, sum(least(e, (bucket + 1) * 1e6) - greatest(e - size, bucket * 1e6)) AS v FROM p GROUP BY ALL)
    SELECT bond, bucket, last_us, round(avg(abs(buy - sell) / 1e6) OVER (PARTITION BY bond ORDER BY bucket ROWS 9 PRECEDING), 6) AS vpin FROM b WHERE v >= 1e6 * (1 - 1e-9)"""
)
def factor_vpin(spark: SparkSession, d: str) -> DataFrame:
    """One-sidedness of the last ten volume buckets of a million each."""
    cut = T.volume_buckets(trades(spark, d), "bond", "us", "size", "side", ["trade_id", "price", "size", "side"], 1e6)
    return T.vpin(cut, "bond", 1e6, 10).select("bond", "bucket", "last_us", F.round("vpin", 6).alias("vpin"))


@query(
    TRADES
    + """, q AS (SELECT bond, quantile_cont(size, 0.5) AS m, quantile_cont(size, 0.9) AS h FROM trades WHERE size IS NOT NULL GROUP BY bond)
    SELECT trade_id, CASE WHEN size >= h THEN round(-side * least(sqrt(size / greatest(m, 1e-9)), 5), 6) WHEN size IS NOT NULL THEN 0 END AS pressure FROM trades LEFT JOIN q USING (bond)"""
)
def print_large_reversal(spark: SparkSession, d: str) -> DataFrame:
    """Pressure against large prints."""
    out = T.large_print_pressure(trades(spark, d), "bond", "size", "side")
    return out.select("trade_id", F.round("pressure", 6).alias("pressure"))


@query(
    TRADES
    + """ SELECT trade_id, round(lead(price, 1) OVER w - price, 6) AS move_30m, round(lead(price, 8) OVER w - price, 6) AS move_1d, round(lead(side * size, 1) OVER w, 2) AS flow_30m, lead(side) OVER w AS next_side FROM trades
    WINDOW w AS (PARTITION BY bond ORDER BY us, trade_id, price, size, side)"""
)
def print_forward_labels(spark: SparkSession, d: str) -> DataFrame:
    """Moves one and eight trades on, the next signed size and the next side."""
    rows = trades(spark, d).withColumn("flow", F.col("side") * F.col("size"))
    out = T.forward(rows, "bond", "us", ["trade_id", "price", "size", "side"], ["price", "flow", "side"], [1, 8])
    return out.select("trade_id", F.round(F.col("price_1") - F.col("price"), 6).alias("move_30m"), F.round(F.col("price_8") - F.col("price"), 6).alias("move_1d"), F.round("flow_1", 2).alias("flow_30m"), F.col("side_1").alias("next_side"))


@query(
    TRADES
    + """ SELECT a.trade_id, round((SELECT b.price FROM trades b WHERE b.bond = a.bond AND b.us >= a.us + 86400000000 ORDER BY b.us, b.trade_id, b.price LIMIT 1), 6) AS future FROM trades a"""
)
def print_future_price(spark: SparkSession, d: str) -> DataFrame:
    """The bond's first price a day later or more."""
    out = T.first_at_or_after(trades(spark, d), "bond", "us", "price", buckets.DAY, ["trade_id"])
    return out.select("trade_id", F.round("future", 6).alias("future"))


@query(
    TRADES
    + """, n AS (SELECT side, lead(side) OVER (PARTITION BY bond ORDER BY us, trade_id, price, size) AS nx FROM trades) SELECT CAST(count(nx) AS BIGINT) AS n, round(avg(CAST(side = nx AS INT)) - 0.5, 7) AS persistence FROM n WHERE nx IS NOT NULL"""
)
def tape_sign_persistence(spark: SparkSession, d: str) -> DataFrame:
    """How much oftener than half the next trade is on the same side."""
    rows = T.forward(trades(spark, d), "bond", "us", ["trade_id", "price", "size"], ["side"], [1]).where("side_1 IS NOT NULL")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("side") == F.col("side_1")).cast("int")) - 0.5, 7).alias("persistence"))


@query(
    DAILY
    + """, c AS (SELECT issuer_id, day, price - lag(price) OVER (PARTITION BY bond ORDER BY day) AS x FROM daily JOIN bonds ON bond = bond_id WHERE issuer_id IS NOT NULL), g AS (SELECT issuer_id, day, avg(x) AS v FROM c WHERE x IS NOT NULL GROUP BY ALL),
    p AS (SELECT corr(a.v, b.v) AS c, count(*) AS n FROM g a JOIN g b ON a.day = b.day AND a.issuer_id < b.issuer_id GROUP BY a.issuer_id, b.issuer_id)
    SELECT CAST(count(*) FILTER (n > 1 AND c IS NOT NULL AND NOT isnan(c)) AS BIGINT) AS pairs, round(avg(c) FILTER (n > 1 AND c IS NOT NULL AND NOT isnan(c)), 6) AS mean_correlation FROM p"""
)
def tape_comovement(spark: SparkSession, d: str) -> DataFrame:
    """Mean correlation of issuers' daily moves."""
    issuers = table(spark, d, "bonds").where("issuer_id IS NOT NULL").select(F.col("bond_id").alias("bond"), "issuer_id")
    rows = daily(spark, d).withColumn("x", F.col("price") - F.lag("price").over(by_bond())).join(issuers, "bond")
    return T.comovement(rows, "issuer_id", "day", "x").select("pairs", F.round("mean_correlation", 6).alias("mean_correlation"))


@query(
    """WITH a AS (SELECT hour(source_event_time AT TIME ZONE 'UTC') AS h, count(*) AS n FROM trace_trades WHERE source_event_time IS NOT NULL GROUP BY 1), b AS (SELECT hour(source_event_time AT TIME ZONE 'UTC') AS h, count(*) AS n FROM composite_snapshots GROUP BY 1)
    SELECT round(sum(abs(coalesce(a.n / (SELECT sum(n) FROM a), 0) - coalesce(b.n / (SELECT sum(n) FROM b), 0))), 7) AS l1 FROM a FULL JOIN b USING (h)"""
)
def tape_hour_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far the hours of trades and of composites differ as distributions."""
    hours = lambda name: table(spark, d, name).where("source_event_time IS NOT NULL").select(F.hour("source_event_time").alias("h"))
    return T.l1(hours("trace_trades"), hours("composite_snapshots"), "h").select(F.round("l1", 7).alias("l1"))


@query("SELECT CAST(x AS DATE) AS session, CAST(row_number() OVER (ORDER BY x) - 1 AS INT) AS number FROM (SELECT unnest(generate_series(TIMESTAMP '2025-01-01', TIMESTAMP '2025-12-31', INTERVAL 1 DAY)) AS x) WHERE isodow(x) < 6 AND CAST(x AS DATE) != DATE '2025-05-26' QUALIFY row_number() OVER (ORDER BY x) <= 200")
def calendar_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 sessions of 2025 without a holiday in May."""
    del d
    return T.sessions(spark, dt.date(2025, 1, 1), 200, (dt.date(2025, 5, 26),))


@query(
    TRADES
    + """, s AS (SELECT bond, us // 86400000000 AS day, avg(price) - 100 AS a, sum(size * side) / 1e6 AS f FROM trades GROUP BY ALL), u AS (SELECT bond, day, 'value' AS family, greatest(-3, least(3, coalesce(-a, 0))) AS score FROM s UNION ALL SELECT bond, day, 'flow', greatest(-3, least(3, coalesce(f, 0))) FROM s),
    c AS (SELECT bond, day, sum(CASE family WHEN 'flow' THEN 2 ELSE 1 END * score) / sum(CASE family WHEN 'flow' THEN 2 ELSE 1 END) AS score FROM u GROUP BY ALL)
    SELECT bond, day, round(score, 6) AS score, CASE WHEN score > 0 THEN 'long' WHEN score < 0 THEN 'short' ELSE 'flat' END AS direction FROM c"""
)
def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two families of scores, clipped and combined by weight per bond and day."""
    bars = trades(spark, d).groupBy("bond", F.floor(F.col("us") / buckets.DAY).alias("day")).agg((F.avg("price") - 100).alias("a"), (F.sum(F.col("size") * F.col("side")) / 1e6).alias("f"))
    long = bars.select("bond", "day", F.inline(F.array(F.struct(F.lit("value").alias("family"), T.clipped(-F.col("a")).alias("score")), F.struct(F.lit("flow").alias("family"), T.clipped(F.coalesce("f", F.lit(0.0))).alias("score")))))
    return rounded(T.composite(long, ["bond", "day"], "family", "score", {"flow": 2.0}).drop("component_count"), "bond", "day", "direction", digits=6)
