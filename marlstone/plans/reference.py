"""Queries of the tape analytics: state operators, clocks, as-of joins, flow signals, labels, portfolio, metrics, relational."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import buckets
from marlstone.operators import windows as W
from marlstone.sources.tables import table
from marlstone.sources.tape import customer_side, tape, trades

QUERIES, SQL = {}, {}
DAY = W.DAY
TAPE = """WITH tape AS (SELECT user_id AS bond, user_id % 10 AS issuer, epoch_us(ts) AS us, event_id AS id, event_type AS kind,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type IN ('click', 'error') THEN -1 ELSE 0 END AS side, value AS amount FROM events)"""
TRADES = """WITH trades AS (SELECT DISTINCT trade_id, bond_id AS bond, epoch_us(source_event_time) AS us, price, CASE WHEN NOT isnan(notional) THEN notional END AS size,
  coalesce(customer_side, 0) AS side FROM trace_trades WHERE trade_id IS NOT NULL AND bond_id IS NOT NULL AND source_event_time IS NOT NULL AND price IS NOT NULL)"""
DAILY = TRADES + """, daily AS (SELECT bond, us // 86400000000 AS day, avg(price) AS price, coalesce(sum(size), 0) AS volume, coalesce(sum(size * side), 0) AS flow, count(*) AS n FROM trades GROUP BY ALL)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *keys: str, digits: int = 5) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keys, *[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in keys])


def daily(spark: SparkSession, d: str) -> DataFrame:
    size = F.coalesce("size", F.lit(0.0))
    return trades(spark, d).groupBy("bond", F.floor(F.col("us") / DAY).alias("day")).agg(F.avg("price").alias("price"), F.sum(size).alias("volume"), F.sum(size * F.col("side")).alias("flow"), F.count(F.lit(1)).alias("n"))


@query(
    TAPE
    + """ SELECT a.id, count(*) AS op_count, CAST(coalesce(sum(b.side), 0) AS BIGINT) AS op_signed_count, round(sum(b.amount), 5) AS op_sum, round(sum(b.amount * b.side) FILTER (b.side != 0), 5) AS op_signed_sum,
    round(avg(b.amount), 5) AS op_mean, round(sum(b.amount * (1 + b.id % 3)) / sum(1 + b.id % 3), 5) AS op_weighted_mean, round(sum(b.amount * (1 + b.id % 3)) / sum(1 + b.id % 3), 5) AS op_vwap, round(min(b.amount), 5) AS op_min,
    round(max(b.amount), 5) AS op_max, round(arg_min(b.amount, b.us), 5) AS op_first, round(arg_max(b.amount, b.us), 5) AS op_last, round(stddev_samp(b.amount), 5) AS op_std,
    round((a.us - max(b.us)) / 1e6, 5) AS op_time_since_last_event, round(count(*) / 172800.0, 9) AS op_intensity
    FROM tape a JOIN tape b ON a.bond = b.bond AND b.us BETWEEN a.us - 172800000000 AND a.us GROUP BY a.id, a.us"""
)
def state_operators(spark: SparkSession, d: str) -> DataFrame:
    """Registered state operators over the two calendar days up to and with each event."""
    made = lambda w: {f"op_{n}": F.round(c, 9 if n == "intensity" else 5) if n not in ("count", "signed_count") else c.cast("long") for n, c in W.simple_operators("amount", "side", "weight", "us", w, 172_800.0).items()}
    rows = tape(spark, d).withColumn("weight", 1 + F.col("id") % 3 + F.lit(0.0))
    return buckets.trailing(rows, "bond", "us", 2 * DAY, made, strict=False).drop(*rows.columns[:2], "us", "kind", "side", "amount", "weight")


@query(
    TAPE
    + """, obs AS (SELECT a.id, a.us AS ref, b.us, b.amount AS v, extract('hour' FROM make_timestamp(b.us)) AS x FROM tape a JOIN tape b ON a.bond = b.bond AND b.us BETWEEN a.us - 172800000000 AND a.us),
    mid AS (SELECT id, median(v) AS mv, median(x) AS mx, arg_max(v, us) AS l FROM obs GROUP BY id),
    stats AS (SELECT o.id, quantile_cont(v, 0.25) AS percentile_25, median(v) AS percentile_50, median(abs(v - mv)) AS mad, median(abs(x - mx)) AS madx, median((v - mv) * (x - mx)) AS cov,
      sum(v * exp(-0.6931471805599453 * (ref - us) / 1e6 / 3600)) / sum(exp(-0.6931471805599453 * (ref - us) / 1e6 / 3600)) AS ewma, (count(*) FILTER (v <= l) - 0.5) / count(*) AS rolling_rank
      FROM obs o JOIN mid USING (id) GROUP BY o.id),
    slopes AS (SELECT p.id, median((q.v - p.v) / (q.x - p.x)) AS slope FROM obs p JOIN obs q ON p.id = q.id AND p.us < q.us AND p.x != q.x GROUP BY p.id)
    SELECT stats.id, round(percentile_25, 9) AS percentile_25, round(percentile_50, 9) AS percentile_50, round(mad, 9) AS mad, round(ewma, 9) AS ewma, round(slope, 9) AS robust_slope, round(cov, 9) AS robust_covariance,
      CASE WHEN mad * madx != 0 THEN round(greatest(-1, least(1, cov / (mad * madx))), 9) END AS robust_correlation, round(rolling_rank, 9) AS rolling_rank FROM stats LEFT JOIN slopes USING (id)"""
)
def state_robust_operators(spark: SparkSession, d: str) -> DataFrame:
    rows = tape(spark, d).withColumn("hour", F.floor(F.col("us") / 3_600_000_000).cast("long") % 24 + F.lit(0.0))
    out = buckets.seen(rows, "bond", "us", 2 * DAY, lambda placed, w: W.robust_operators(placed, "amount", "hour", "us", w, 3600.0), strict=False)
    return rounded(out.drop(*[c for c in rows.columns if c != "id"]), "id", digits=9)


@query(TAPE + " SELECT id, round((count(*) OVER (PARTITION BY issuer, us // 86400000000 ORDER BY amount RANGE UNBOUNDED PRECEDING) - 0.5) / count(*) OVER (PARTITION BY issuer, us // 86400000000), 6) AS rank FROM tape")
def state_cross_sectional_rank(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.col("us") / DAY)
    group = Window.partitionBy("issuer", day)
    below = F.count(F.lit(1)).over(group.orderBy("amount").rangeBetween(Window.unboundedPreceding, 0))
    return tape(spark, d).select("id", F.round((below - 0.5) / F.count(F.lit(1)).over(group), 6).alias("rank"))


@query(
    TAPE
    + """, runs AS (SELECT *, sum(CASE WHEN prev = side THEN 0 ELSE 1 END) OVER (PARTITION BY bond ORDER BY us, id) AS g FROM (SELECT *, lag(side) OVER (PARTITION BY bond ORDER BY us, id) AS prev FROM tape WHERE side != 0))
    SELECT bond, us, id, CAST(side * row_number() OVER (PARTITION BY bond, g ORDER BY us, id) AS INT) AS run_length FROM runs"""
)
def state_run_length(spark: SparkSession, d: str) -> DataFrame:
    return W.run_length(tape(spark, d), "bond", "us", "side", ["id"])


@query(
    TAPE
    + """, back AS (SELECT a.bond, a.us, a.id, row_number() OVER (PARTITION BY a.id ORDER BY b.us DESC, b.id DESC) AS k, sum(CAST(abs(b.amount) AS DECIMAL(26,12))) OVER (PARTITION BY a.id ORDER BY b.us DESC, b.id DESC) AS s
      FROM tape a JOIN tape b ON a.bond = b.bond AND (b.us, b.id) <= (a.us, a.id))
    SELECT bond, us, id, CAST(min(k) FILTER (s >= 300) AS INT) AS events_needed FROM back GROUP BY ALL"""
)
def clock_notional(spark: SparkSession, d: str) -> DataFrame:
    """How many events back from each it takes until their size is 300, over all of the bond's history."""
    return W.notional_clock(tape(spark, d), "bond", "us", "amount", ["id"], 300.0)


@query(
    """SELECT l_partkey, d AS us, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity,
      (SELECT least(count(*), 5) FROM t b WHERE b.l_partkey = a.l_partkey AND b.d < a.d) AS n_prior,
      (SELECT round(sum(v), 2) FROM (SELECT l_extendedprice AS v FROM t b WHERE b.l_partkey = a.l_partkey AND b.d < a.d
        ORDER BY d DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC LIMIT 5)) AS sum_prior
    FROM (SELECT *, epoch_us(l_shipdate) AS d FROM lineitem) a"""
    .replace("FROM t b", "FROM (SELECT *, epoch_us(l_shipdate) AS d FROM lineitem) b")
)
def window_last_five_strict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("us", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    out = W.last_n(rows, "l_partkey", "us", "l_extendedprice", 5, ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"])
    return out.withColumn("sum_prior", F.round("sum_prior", 2))


def _as_of_sql(op: str, order: str) -> str:
    return TAPE + f""" SELECT a.id, (SELECT b.amount FROM tape b WHERE b.bond = a.bond AND b.kind = 'view' AND b.us {op} a.us ORDER BY b.us {order}, b.amount DESC LIMIT 1) AS amount
      FROM tape a WHERE a.kind = 'purchase'"""


def _as_of(spark: SparkSession, d: str, **kind: bool) -> DataFrame:
    rows = tape(spark, d)
    left = rows.where("kind = 'purchase'").select("bond", "us", "id")
    return W.as_of(left, rows.where("kind = 'view'").select("bond", "us", "amount"), "bond", "us", "amount", **kind).select("id", "amount")


@query(_as_of_sql("<=", "DESC"))
def asof_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d)


@query(_as_of_sql("<", "DESC"))
def asof_strict(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d, strict=True)


@query(_as_of_sql(">", "ASC"))
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d, strict=True, forward=True)


def _prior(columns: str, hours: int = 24) -> str:
    return TAPE + f" SELECT a.id, {columns} FROM tape a LEFT JOIN tape b ON a.bond = b.bond AND b.us >= a.us - {hours * 3_600_000_000} AND b.us < a.us GROUP BY a.id"


@query(_prior("round(sum(b.side) / nullif(count(*) FILTER (b.side != 0), 0), 6) AS a1, CAST(count(*) FILTER (b.side != 0) AS BIGINT) AS events", 72))
def a1_count_imbalance(spark: SparkSession, d: str) -> DataFrame:
    made = lambda w: {"a1": F.round(W.imbalance("side", F.lit(1.0), w), 6), "events": F.count(F.when(F.col("side") != 0, 1)).over(w)}
    return buckets.trailing(tape(spark, d), "bond", "us", 3 * DAY, made).select("id", "a1", "events")


@query(_prior("round(sum(b.side * b.amount) FILTER (b.side != 0) / sum(abs(b.amount)) FILTER (b.side != 0), 9) AS a2", 72))
def a2_notional_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return buckets.trailing(tape(spark, d), "bond", "us", 3 * DAY, lambda w: {"a2": F.round(W.imbalance("side", F.col("amount"), w), 9)}).select("id", "a2")


@query(
    TAPE
    + """, sums AS (SELECT a.id, sum(exp(-0.6931471805599453 * (a.us - b.us) / 8.64e10)) FILTER (b.side = 1) / 86400 AS buys,
      sum(exp(-0.6931471805599453 * (a.us - b.us) / 8.64e10)) FILTER (b.side = -1) / 86400 AS sells FROM tape a LEFT JOIN tape b ON a.bond = b.bond AND b.us < a.us AND b.side != 0 GROUP BY a.id)
    SELECT id, CAST(format('{:.8e}', buys) AS DOUBLE) AS buy_intensity, CAST(format('{:.8e}', sells) AS DOUBLE) AS sell_intensity FROM sums"""
)
def a3_intensity(spark: SparkSession, d: str) -> DataFrame:
    """Decayed buys and sells a second over all of the bond's history, half-life a day; NULL before the first of a side. To nine digits, as old sums are small."""
    sides = {"buy_intensity": F.when(F.col("side") == 1, 1.0), "sell_intensity": F.when(F.col("side") == -1, 1.0)}
    rows = W.decayed_history(tape(spark, d), "bond", "us", DAY, sides)
    return rows.select("id", *[F.when(F.col(n).isNotNull(), F.format_string("%.8e", n).cast("double")).alias(n) for n in sides])


@query(
    TAPE
    + """ SELECT a.id, arg_max(b.side, b.us) AS last_side, round((a.us - max(b.us)) / 1e6, 3) AS seconds_since FROM tape a LEFT JOIN tape b ON a.bond = b.bond AND b.us < a.us AND b.side != 0 GROUP BY a.id, a.us"""
)
def a4_last_side(spark: SparkSession, d: str) -> DataFrame:
    rows = buckets.known(tape(spark, d), "bond", "us", F.when(F.col("side") != 0, F.struct("us", "side")), name="_l")
    return rows.select("id", F.col("_l.side").alias("last_side"), F.round((F.col("us") - F.col("_l.us")) / 1e6, 3).alias("seconds_since"))


@query(
    TAPE
    + """ SELECT a.id, round((count(b.us) FILTER (b.us >= a.us - 86400000000)) * 10.0 / nullif(count(b.us), 0), 6) AS a5 FROM tape a
      LEFT JOIN tape b ON a.bond = b.bond AND b.us >= a.us - 864000000000 AND b.us < a.us GROUP BY a.id"""
)
def a5_activity_surprise(spark: SparkSession, d: str) -> DataFrame:
    """Events of the day before over their daily mean of ten days."""
    rows = tape(spark, d)
    for name, days in (("short", 1), ("long", 10)):
        rows = buckets.trailing(rows, "bond", "us", days * DAY, lambda w, name=name: {name: F.count(F.lit(1)).over(w)})
    return rows.select("id", F.round(F.try_divide(F.col("short") * 10.0, F.col("long")), 6).alias("a5"))


@query(
    TAPE
    + """ SELECT a.id, round(1 / (1.0 + count(b.us)), 6) AS crowding, round(1 - abs(sum(b.side)) / nullif(count(*) FILTER (b.side != 0), 0), 6) AS disagreement
      FROM tape a LEFT JOIN tape b ON a.issuer = b.issuer AND b.us >= a.us - 86400000000 AND b.us < a.us GROUP BY a.id"""
)
def issuer_crowding(spark: SparkSession, d: str) -> DataFrame:
    """Over the issuer's events of the day before; those of a repeated id are added up."""
    counts = {"n": F.lit(1), "net": F.col("side"), "sided": F.abs("side")}
    rows = buckets.summed(tape(spark, d), ["id"], "issuer", "us", DAY, counts)
    rows = rows.groupBy("id").agg(*[F.sum(n).alias(n) for n in counts])
    return rows.select("id", F.round(1 / (1.0 + F.col("n")), 6).alias("crowding"), F.round(1 - F.try_divide(F.abs("net"), F.col("sided")), 6).alias("disagreement"))


@query(
    TRADES
    + """ SELECT trade_id, round(lead(price, 3) OVER w - price, 6) AS target, CAST(lead(price, 3) OVER w > price AS BOOLEAN) AS up, round(-side * (lead(price, 3) OVER w - price), 6) AS dealer_markout,
      lead(side) OVER w AS next_side, lead(price, 3) OVER w IS NULL AS censored FROM trades WINDOW w AS (PARTITION BY bond ORDER BY us, trade_id)"""
)
def label_forward(spark: SparkSession, d: str) -> DataFrame:
    """Forward moves three trades on, the dealer's markout against the customer's side, and the next side; the end is censored."""
    w = Window.partitionBy("bond").orderBy("us", "trade_id")
    ahead = F.lead("price", 3).over(w)
    move = ahead - F.col("price")
    return trades(spark, d).select("trade_id", F.round(move, 6).alias("target"), (ahead > F.col("price")).alias("up"), F.round(-F.col("side") * move, 6).alias("dealer_markout"), F.lead("side").over(w).alias("next_side"), ahead.isNull().alias("censored"))


@query(
    """SELECT sector, rating, CAST(count(*) AS BIGINT) AS n, CAST(count(responded) AS BIGINT) AS labelled, round(avg(CASE WHEN responded IS NULL THEN 0 ELSE 1 END), 6) AS coverage
    FROM (SELECT DISTINCT event_id, bond_id, responded FROM label_events) e LEFT JOIN bonds b ON e.bond_id = b.bond_id GROUP BY sector, rating"""
)
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    bonds = table(spark, d, "bonds").select("bond_id", "sector", "rating")
    rows = table(spark, d, "label_events").select("event_id", "bond_id", "responded").distinct().join(bonds, "bond_id", "left")
    known = F.col("responded").isNotNull()
    return rows.groupBy("sector", "rating").agg(F.count(F.lit(1)).alias("n"), F.count("responded").alias("labelled"), F.round(F.avg(known.cast("int")), 6).alias("coverage"))


@query(
    DAILY
    + """, s AS (SELECT bond, day, flow AS signal FROM daily), r AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY signal) AS k, count(*) OVER (PARTITION BY day, signal) AS t, count(*) OVER (PARTITION BY day) AS n FROM s),
    c AS (SELECT *, (k + (t - 1) / 2.0) - (n + 1) / 2.0 AS centred FROM r) SELECT bond, day, round(CASE WHEN sum(abs(centred)) OVER (PARTITION BY day) > 0 THEN centred / sum(abs(centred)) OVER (PARTITION BY day) END, 8) AS weight FROM c"""
)
def portfolio_linear_rank_halves(spark: SparkSession, d: str) -> DataFrame:
    """Average ranks of a day's signals, centred, with gross weight one."""
    day = Window.partitionBy("day")
    rows = daily(spark, d).select("bond", "day", "flow", F.rank().over(day.orderBy("flow")).alias("k"))
    rows = rows.withColumn("c", F.col("k") + (F.count(F.lit(1)).over(Window.partitionBy("day", "flow")) - 1) / 2 - (F.count(F.lit(1)).over(day) + 1) / 2)
    return rows.select("bond", "day", F.round(F.try_divide(F.col("c"), F.sum(F.abs("c")).over(day)), 8).alias("weight"))


@query(
    DAILY
    + """, w AS (SELECT bond, day, flow / nullif(sum(abs(flow)) OVER (PARTITION BY day), 0) AS raw FROM daily) SELECT bond, day, round(greatest(-0.05, least(0.05, raw)), 8) AS weight FROM w"""
)
def portfolio_capped(spark: SparkSession, d: str) -> DataFrame:
    raw = F.try_divide(F.col("flow"), F.sum(F.abs("flow")).over(Window.partitionBy("day")))
    return daily(spark, d).select("bond", "day", F.round(F.when(raw.isNotNull(), F.greatest(F.lit(-0.05), F.least(F.lit(0.05), raw))), 8).alias("weight"))


@query(
    DAILY
    + """, p AS (SELECT bond, day, price / lag(price) OVER (PARTITION BY bond ORDER BY day) - 1 AS r FROM daily), m AS (SELECT day, avg(r) AS pnl FROM p WHERE r IS NOT NULL GROUP BY day),
    c AS (SELECT day, pnl, sum(pnl) OVER (ORDER BY day) AS total FROM m) SELECT day, round(pnl, 8) AS pnl, round(total, 8) AS total, round(total - max(total) OVER (ORDER BY day), 8) AS drawdown FROM c"""
)
def pnl_drawdown(spark: SparkSession, d: str) -> DataFrame:
    """Of an equally weighted book; one row a day, so the global window is over days only."""
    r = F.col("price") / F.lag("price").over(Window.partitionBy("bond").orderBy("day")) - 1
    days = daily(spark, d).withColumn("r", r).where("r IS NOT NULL").groupBy("day").agg(F.avg("r").alias("pnl"))
    total = F.sum("pnl").over(Window.orderBy("day"))
    peak = F.max("total").over(Window.orderBy("day"))
    return rounded(days.withColumn("total", total).withColumn("drawdown", F.col("total") - peak), "day", digits=8)


@query(
    DAILY
    + """ SELECT bond, day, round(price / lag(price, 5) OVER w - 1, 8) AS momentum, round(avg(price) OVER f5 - avg(price) OVER f20, 8) AS crossover,
      CASE WHEN price >= max(price) OVER f20 THEN 1 WHEN price <= min(price) OVER f20 THEN -1 ELSE 0 END AS breakout, round((price - avg(price) OVER f20) / nullif(stddev_samp(price) OVER f20, 0), 5) AS zscore
      FROM daily WINDOW w AS (PARTITION BY bond ORDER BY day), f5 AS (PARTITION BY bond ORDER BY day ROWS 4 PRECEDING), f20 AS (PARTITION BY bond ORDER BY day ROWS 19 PRECEDING)"""
)
def fx_trend(spark: SparkSession, d: str) -> DataFrame:
    """Momentum, moving-average crossover, breakout and z-score per asset."""
    w = Window.partitionBy("bond").orderBy("day")
    f5, f20, p = w.rowsBetween(-4, 0), w.rowsBetween(-19, 0), F.col("price")
    breakout = F.when(p >= F.max(p).over(f20), 1).when(p <= F.min(p).over(f20), -1).otherwise(0)
    return daily(spark, d).select(
        "bond", "day", F.round(p / F.lag(p, 5).over(w) - 1, 8).alias("momentum"), F.round(F.avg(p).over(f5) - F.avg(p).over(f20), 8).alias("crossover"), breakout.alias("breakout"),
        F.round(F.try_divide(p - F.avg(p).over(f20), F.stddev_samp(p).over(f20)), 5).alias("zscore"),
    )


@query(
    DAILY
    + """, p AS (SELECT bond, price - lag(price, 2) OVER w AS x, lead(price, 2) OVER w - price AS y FROM daily WINDOW w AS (PARTITION BY bond ORDER BY day)),
    k AS (SELECT bond, rank() OVER (PARTITION BY bond ORDER BY x) + (count(*) OVER (PARTITION BY bond, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY bond ORDER BY y) + (count(*) OVER (PARTITION BY bond, y) - 1) / 2.0 AS ry
      FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
    SELECT bond, CAST(count(*) AS BIGINT) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(corr(rx, ry), 6) END AS spearman FROM k GROUP BY bond"""
)
def triplet_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the move over two days back and two days on, per bond; NULL without variation."""
    w = Window.partitionBy("bond").orderBy("day")
    rows = daily(spark, d).select("bond", (F.col("price") - F.lag("price", 2).over(w)).alias("x"), (F.lead("price", 2).over(w) - F.col("price")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")

    def mean_rank(c: str):
        return F.rank().over(Window.partitionBy("bond").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("bond", c)) - 1) / 2

    ranks = rows.select("bond", mean_rank("x").alias("rx"), mean_rank("y").alias("ry"))
    varied = (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0)
    return ranks.groupBy("bond").agg(F.count(F.lit(1)).alias("n"), F.round(F.when(varied, F.corr("rx", "ry")), 6).alias("spearman"))


@query(
    """WITH e AS (SELECT DISTINCT event_id, quoted_spread AS s, CAST(won AS INT) AS y FROM label_events WHERE won IS NOT NULL AND quoted_spread IS NOT NULL AND NOT isnan(quoted_spread)),
    r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM e)
    SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(count(*) AS BIGINT) AS n, round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 8) AS auc FROM r"""
)
def metric_auc(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve from score counts: ranks come from running counts of distinct scores, cut into value buckets."""
    from marlstone.operators.skew import value_bucket

    rows = table(spark, d, "label_events").where("won IS NOT NULL AND quoted_spread IS NOT NULL AND NOT isnan(quoted_spread)").select("event_id", "quoted_spread", F.col("won").cast("int").alias("y")).distinct()
    scores = rows.groupBy(F.col("quoted_spread").alias("s")).agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("p")).withColumn("b", value_bucket(F.col("s"), 256))
    base = scores.groupBy("b").agg(F.sum("m").alias("mb")).select("b", F.coalesce(F.sum("mb").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    below = F.col("base") + F.sum("m").over(Window.partitionBy("b").orderBy("s")) - F.col("m")
    ranked = scores.join(base, "b").withColumn("k", below + (F.col("m") + 1) / 2)
    out = ranked.agg(F.sum("p").alias("positives"), F.sum("m").alias("n"), F.sum(F.col("k") * F.col("p")).alias("t"))
    positives = F.col("positives")
    return out.select("positives", "n", F.round((F.col("t") - positives * (positives + 1) / 2) / (positives * (F.col("n") - positives)), 8).alias("auc"))


@query(
    TRADES
    + """, p AS (SELECT bond, us, price, size, side, price - lag(price) OVER (PARTITION BY bond ORDER BY us, trade_id) AS dp FROM trades)
    SELECT bond, round(avg(abs(dp) / nullif(size, 0)) * 1e6, 5) AS amihud, CASE WHEN NOT isnan(regr_slope(dp, size * side)) THEN round(regr_slope(dp, size * side) * 1e6, 5) END AS impact, round(sum(price * size) / nullif(sum(CASE WHEN size IS NOT NULL THEN size END), 0), 5) AS vwap,
      round(stddev_samp(dp), 6) AS volatility, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY bond"""
)
def factor_liquidity(spark: SparkSession, d: str) -> DataFrame:
    """Illiquidity, price impact, volume-weighted price and volatility per bond."""
    move = F.col("price") - F.lag("price").over(Window.partitionBy("bond").orderBy("us", "trade_id"))
    rows = trades(spark, d).withColumn("dp", move)
    size = F.col("size")
    return rows.groupBy("bond").agg(
        F.round(F.avg(F.try_divide(F.abs("dp"), size)) * 1e6, 5).alias("amihud"), F.round(F.regr_slope(F.col("dp"), size * F.col("side")) * 1e6, 5).alias("impact"),
        F.round(F.try_divide(F.sum(F.col("price") * size), F.sum(size)), 5).alias("vwap"), F.round(F.stddev_samp("dp"), 6).alias("volatility"), F.count(F.lit(1)).alias("n"),
    )


@query(
    """SELECT raw_side, CASE WHEN lower(trim(raw_side)) IN ('1', 'buy', 'b', 'customer_buy', 'client_buy', 'client buys', 'customer buys') THEN 1 WHEN lower(trim(raw_side)) IN ('-1', 'sell', 's', 'customer_sell', 'client_sell', 'client sells', 'customer sells') THEN -1 END AS side,
    CAST(count(*) AS BIGINT) AS n FROM trace_trades GROUP BY ALL"""
)
def source_sides(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "trace_trades").select("raw_side", customer_side(F.col("raw_side")).alias("side"))
    return rows.groupBy("raw_side", "side").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT c AS column_name, round(avg(v), 6) AS null_rate FROM (UNPIVOT (SELECT CAST(bond_id IS NULL AS INT) AS bond_id, CAST(price IS NULL AS INT) AS price, CAST(issuer_id IS NULL AS INT) AS issuer_id, CAST(receive_time IS NULL AS INT) AS receive_time FROM trace_trades) ON COLUMNS(*) INTO NAME c VALUE v) GROUP BY c"
)
def profile_null_rates(spark: SparkSession, d: str) -> DataFrame:
    names = ["bond_id", "price", "issuer_id", "receive_time"]
    rates = table(spark, d, "trace_trades").agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in names])
    return rates.unpivot([], names, "column_name", "null_rate").select("column_name", F.round("null_rate", 6).alias("null_rate"))


@query(TAPE + " SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, make_timestamp(us))) AS start_us, kind, CAST(count(*) AS BIGINT) AS n, round(sum(amount), 4) AS total FROM tape GROUP BY ALL")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = F.window(F.timestamp_micros("us"), "6 hours")
    return tape(spark, d).groupBy(w.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("total")).select(F.unix_micros("w.start").alias("start_us"), "kind", "n", "total")


@query(
    TAPE
    + """, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY bond ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS new FROM tape), s AS (SELECT *, sum(new) OVER (PARTITION BY bond ORDER BY us) AS k FROM g)
    SELECT bond, min(us) AS start_us, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY bond, k"""
)
def window_session(spark: SparkSession, d: str) -> DataFrame:
    w = F.session_window(F.timestamp_micros("us"), "6 hours")
    return tape(spark, d).groupBy(w.alias("w"), "bond").agg(F.count(F.lit(1)).alias("n")).select("bond", F.unix_micros("w.start").alias("start_us"), "n")


@query("SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def relational_rollup(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")).select("n_name", "r_name", "n", "balance")


@query("SELECT l_linestatus, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS A, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS N, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS R FROM lineitem GROUP BY 1")
def relational_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return out.select("l_linestatus", *[F.round(c, 2).alias(c) for c in "ANR"])


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45) AND p_size IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def relational_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "nation").where("n_regionkey = 1")
    rows = table(spark, d, "part").join(sizes, F.col("p_size") == F.col("n_nationkey"), "left_semi")
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return rows.join(returned, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def relational_top_three(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")
