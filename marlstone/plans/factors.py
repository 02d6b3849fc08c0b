"""Factors, calendars, fitted weights, evaluation and further relational queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import buckets
from marlstone.plans.reference import DAILY, TAPE, TRADES, daily
from marlstone.sources.tables import finite, micros, plain_id, table
from marlstone.sources.tape import tape, trades

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def add_business_days(day: Column, n: int) -> Column:
    """``n`` >= 0 weekdays after ``day``; a weekend day counts as the Friday before it. Closed form, no calendar table."""
    weekday = F.weekday(day)  # Monday is 0
    friday = F.date_sub(day, F.greatest(weekday - 4, F.lit(0)))
    at = F.least(weekday, F.lit(4)) + n
    return F.date_add(friday, (F.lit(n) + 2 * F.floor(at / 5)).cast("int"))


@query(
    """SELECT DISTINCT l_shipdate, (SELECT max(d) FROM (SELECT CAST(x AS DATE) AS d FROM (SELECT unnest(generate_series(CAST(l_shipdate AS TIMESTAMP) + INTERVAL 1 DAY, CAST(l_shipdate AS TIMESTAMP) + INTERVAL 12 DAY, INTERVAL 1 DAY)) AS x)
      WHERE isodow(x) < 6 ORDER BY x LIMIT 5)) AS settles FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem)"""
)
def calendar_business_days(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("l_shipdate")).distinct()
    return days.select("l_shipdate", add_business_days(F.col("l_shipdate"), 5).alias("settles"))


@query(
    TRADES
    + """, days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT us // 86400000000 AS day FROM trades))
    SELECT day, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split, CAST(count(*) AS BIGINT) AS n FROM trades JOIN days ON us // 86400000000 = day GROUP BY ALL"""
)
def split_by_date(spark: SparkSession, d: str) -> DataFrame:
    """Chronological splits by distinct day. The global window runs over days only."""
    days = trades(spark, d).groupBy(F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    i, n = F.row_number().over(Window.orderBy("day")) - 1, F.count(F.lit(1)).over(Window.partitionBy())
    split = F.when(i < F.floor(n * 0.6), "train").when(i < F.floor(n * 0.8), "validation").otherwise("test")
    return days.select("day", split.alias("split"), F.col("rows").alias("n"))


_SCORED = """WITH e AS (SELECT DISTINCT event_id, issuer_id, epoch_us(prediction_timestamp) // 86400000000 AS day, least(quoted_spread, 1) AS p, CAST(won AS INT) AS y FROM label_events
  WHERE won IS NOT NULL AND quoted_spread IS NOT NULL AND NOT isnan(quoted_spread) AND event_id IS NOT NULL)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "label_events").where("won IS NOT NULL AND quoted_spread IS NOT NULL AND NOT isnan(quoted_spread) AND event_id IS NOT NULL")
    return rows.select("event_id", "issuer_id", F.floor(micros("prediction_timestamp") / 86_400_000_000).alias("day"), F.least("quoted_spread", F.lit(1.0)).alias("p"), F.col("won").cast("int").alias("y")).distinct()


@query(
    _SCORED
    + """ SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(CAST(p AS DECIMAL(20, 12))) AS DOUBLE) / count(*), 9) AS mean_score, round(avg(y), 9) AS rate,
      round(avg(-(y * ln(greatest(p, 1e-6)) + (1 - y) * ln(greatest(1 - p, 1e-6)))), 9) AS log_loss, round(avg((p - y) * (p - y)), 9) AS brier FROM e GROUP BY bin"""
)
def metric_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Scores as probabilities in ten bins: mean score, rate and logarithmic loss, from which calibration error follows."""
    p, y = F.col("p"), F.col("y")
    loss = -(y * F.log(F.greatest(p, F.lit(1e-6))) + (1 - y) * F.log(F.greatest(1 - p, F.lit(1e-6))))
    return _scored(spark, d).groupBy(F.least(F.floor(p * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(p.cast("decimal(20,12)")).cast("double") / F.count(F.lit(1)), 9).alias("mean_score"), F.round(F.avg(y), 9).alias("rate"), F.round(F.avg(loss), 9).alias("log_loss"), F.round(F.avg((p - y) * (p - y)), 9).alias("brier"))


@query(
    _SCORED
    + """, m AS (SELECT issuer_id, avg(p) AS mp, avg(y) AS my FROM e WHERE issuer_id IS NOT NULL GROUP BY ALL)
    SELECT e.issuer_id, round(sum((p - mp) * (y - my)) / (sum((p - mp) * (p - mp)) + 1), 7) AS slope, CAST(count(*) AS BIGINT) AS n FROM e JOIN m ON e.issuer_id = m.issuer_id GROUP BY ALL"""
)
def model_ridge_by_issuer(spark: SparkSession, d: str) -> DataFrame:
    """Ridge slope (penalty 1) per issuer in closed form, from one pass of Gram sums."""
    n, x, y = F.count(F.lit(1)), F.avg("p"), F.avg("y")
    cross, square = F.sum(F.col("p") * F.col("y")) - n * x * y, F.sum(F.col("p") * F.col("p")) - n * x * x
    return _scored(spark, d).where("issuer_id IS NOT NULL").groupBy("issuer_id").agg(F.round(cross / (square + 1), 7).alias("slope"), n.alias("n"))


@query(
    TRADES
    + """, q AS (SELECT DISTINCT snapshot_id, upper(trim(bond_id)) AS bond, epoch_us(source_event_time) AS us FROM composite_snapshots WHERE snapshot_id IS NOT NULL AND bond_id IS NOT NULL)
    SELECT trade_id, CAST(count(*) AS BIGINT) AS quotes FROM trades JOIN q ON trades.bond = q.bond AND q.us BETWEEN trades.us - 120000000 AND trades.us + 120000000 GROUP BY trade_id"""
)
def range_join_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes within two minutes of each trade: each quote goes to the two-minute cells it can touch, joined by cell."""
    reach = 120_000_000
    quotes = table(spark, d, "composite_snapshots").where("snapshot_id IS NOT NULL AND bond_id IS NOT NULL").select("snapshot_id", plain_id("bond_id").alias("bond"), micros("source_event_time").alias("q_us")).distinct()
    cell = F.floor(F.col("q_us") / reach)
    quotes = quotes.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    rows = trades(spark, d).withColumn("cell", F.floor(F.col("us") / reach))
    near = rows.join(quotes, ["bond", "cell"]).where(F.abs(F.col("q_us") - F.col("us")) <= reach)
    return near.groupBy("trade_id").agg(F.count(F.lit(1)).alias("quotes"))


@query(
    DAILY
    + """, p AS (SELECT bond, day, price - lag(price) OVER (PARTITION BY bond ORDER BY day) AS c FROM daily),
    s AS (SELECT bond, day, sum(greatest(c, 0)) OVER w AS up, sum(greatest(-c, 0)) OVER w AS down FROM p WINDOW w AS (PARTITION BY bond ORDER BY day ROWS 13 PRECEDING))
    SELECT bond, day, round(100 * up / nullif(up + down, 0), 6) AS rsi FROM s"""
)
def factor_rsi(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("bond").orderBy("day")
    w, c = order.rowsBetween(-13, 0), F.col("c")
    rows = daily(spark, d).withColumn("c", F.col("price") - F.lag("price").over(order))
    up = F.sum(F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))).over(w)
    down = F.sum(F.when(c.isNotNull(), F.greatest(-c, F.lit(0.0)))).over(w)
    return rows.select("bond", "day", F.round(100 * F.try_divide(up, up + down), 6).alias("rsi"))


@query(
    DAILY
    + """ SELECT bond, day, round((flow - avg(flow) OVER w) / nullif(stddev_samp(flow) OVER w, 0), 6) AS flow_z, round(sum(abs(flow)) OVER f / nullif(sum(volume) OVER f, 0), 6) AS toxicity,
      round(volume / nullif(avg(volume) OVER w, 0), 6) AS volume_surprise FROM daily
      WINDOW w AS (PARTITION BY bond ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY bond ORDER BY day ROWS 4 PRECEDING)"""
)
def factor_flow(spark: SparkSession, d: str) -> DataFrame:
    """Flow against its last 20 active days, one-sidedness of five days, and volume against its mean."""
    order = Window.partitionBy("bond").orderBy("day")
    w, f, flow, volume = order.rowsBetween(-20, -1), order.rowsBetween(-4, 0), F.col("flow"), F.col("volume")
    return daily(spark, d).select(
        "bond", "day", F.round(F.try_divide(flow - F.avg(flow).over(w), F.stddev_samp(flow).over(w)), 6).alias("flow_z"),
        F.round(F.try_divide(F.sum(F.abs(flow)).over(f), F.sum(volume).over(f)), 6).alias("toxicity"), F.round(F.try_divide(volume, F.avg(volume).over(w)), 6).alias("volume_surprise"),
    )


@query(
    DAILY
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY bond ORDER BY day) AS k FROM daily)
    SELECT a.bond, a.day, round(sum(b.price * pow(0.8, a.k - b.k)) / sum(pow(0.8, a.k - b.k)), 6) AS ema FROM n a JOIN n b ON a.bond = b.bond AND b.k BETWEEN a.k - 29 AND a.k GROUP BY ALL"""
)
def factor_ema(spark: SparkSession, d: str) -> DataFrame:
    """Exponential mean of the last 30 active days, weights falling by a fifth a day and normalised."""
    seen = F.reverse(F.collect_list("price").over(Window.partitionBy("bond").orderBy("day").rowsBetween(-29, 0)))
    weights = F.transform(F.sequence(F.lit(0), F.size(seen) - 1), lambda k: F.pow(F.lit(0.8), k))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return daily(spark, d).select("bond", "day", F.round(total(F.zip_with(seen, weights, lambda p, w: p * w)) / total(weights), 6).alias("ema"))


@query(
    DAILY
    + """, r AS (SELECT d.bond, issuer_id, day, price / lag(price) OVER (PARTITION BY d.bond ORDER BY day) - 1 AS r FROM daily d JOIN bonds b ON d.bond = b.bond_id WHERE issuer_id IS NOT NULL)
    SELECT bond, day, round(r - avg(r) OVER (PARTITION BY issuer_id, day), 8) AS residual FROM r WHERE r IS NOT NULL"""
)
def factor_issuer_residual(spark: SparkSession, d: str) -> DataFrame:
    issuers = table(spark, d, "bonds").where("issuer_id IS NOT NULL").select(F.col("bond_id").alias("bond"), "issuer_id")
    r = F.col("price") / F.lag("price").over(Window.partitionBy("bond").orderBy("day")) - 1
    rows = daily(spark, d).join(issuers, "bond").withColumn("r", r).where("r IS NOT NULL")
    return rows.select("bond", "day", F.round(F.col("r") - F.avg("r").over(Window.partitionBy("issuer_id", "day")), 8).alias("residual"))


@query(TAPE + " SELECT a.id, CAST(count(b.id) AS BIGINT) AS followers FROM tape a LEFT JOIN tape b ON a.issuer = b.issuer AND a.bond != b.bond AND b.us > a.us AND b.us <= a.us + 3600000000 GROUP BY a.id")
def leader_followers(spark: SparkSession, d: str) -> DataFrame:
    """Events of the issuer's other bonds in the hour after each event: the issuer's frame less the bond's own."""
    rows = tape(spark, d)
    for key in ("issuer", "bond"):
        rows = buckets.trailing(rows, key, "us", 3_600_000_000, lambda w, key=key: {f"n_{key}": F.count(F.lit(1)).over(w)}, ahead=True)
    return rows.select("id", (F.col("n_issuer") - F.col("n_bond")).alias("followers"))


@query("SELECT bond_id, trade_id FROM (SELECT DISTINCT bond_id, trade_id FROM trace_trades WHERE bond_id IS NOT NULL AND trade_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY bond_id ORDER BY md5(trade_id), trade_id) <= 5")
def sample_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: five trades a bond by hash, the same in every run."""
    rows = table(spark, d, "trace_trades").where("bond_id IS NOT NULL AND trade_id IS NOT NULL").select("bond_id", "trade_id").distinct()
    w = Window.partitionBy("bond_id").orderBy(F.md5("trade_id"), "trade_id")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST('0x' || substr(md5(coalesce(trade_id, '') || '|' || coalesce(bond_id, '')), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM trace_trades")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a table that does not depend on the order of rows."""
    text = F.concat(F.coalesce("trade_id", F.lit("")), F.lit("|"), F.coalesce("bond_id", F.lit("")))
    return table(spark, d, "trace_trades").agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")).alias("digest"))


@query(
    """SELECT bond_id, 'both' AS place FROM (SELECT bond_id FROM trace_trades INTERSECT SELECT bond_id FROM bonds) WHERE bond_id IS NOT NULL
    UNION ALL SELECT bond_id, 'trades only' FROM (SELECT bond_id FROM trace_trades EXCEPT SELECT bond_id FROM bonds) WHERE bond_id IS NOT NULL"""
)
def relational_set_operations(spark: SparkSession, d: str) -> DataFrame:
    traded, known = (table(spark, d, t).select("bond_id").where("bond_id IS NOT NULL") for t in ("trace_trades", "bonds"))
    return traded.intersect(known).withColumn("place", F.lit("both")).unionByName(traded.subtract(known).withColumn("place", F.lit("trades only")))


@query("SELECT sector, rating, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN NOT isnan(coupon) THEN coupon END), 6) AS coupon FROM bonds GROUP BY CUBE (sector, rating)")
def relational_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bonds").cube("sector", "rating").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(finite("coupon")), 6).alias("coupon"))
