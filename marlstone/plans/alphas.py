"""Queries of the alphas on the grid of label events, over whole tables.

The grid is every distinct label event with bond and time; requests are those of source 'rfq', executions and firm-ups the
requests so flagged, trades the side-valid events of source 'trace'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import alphas as A
from marlstone.operators import windows as W
from marlstone.operators.buckets import DAY
from marlstone.plans.reference import rounded
from marlstone.sources.tables import finite, micros, table

QUERIES, SQL = {}, {}
HOUR = 3_600_000_000
SOURCES = {"requests": "source = 'rfq'", "firm_ups": "source = 'rfq' AND firmed_up", "executions": "source = 'rfq' AND executed", "trades": "source = 'trace' AND side_valid"}
WINDOWS, COUNTS = {"4h": 4 * HOUR, "3d": 3 * DAY}, (5, 25)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def grid(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "label_events").where("event_id IS NOT NULL AND bond_id IS NOT NULL AND prediction_timestamp IS NOT NULL").dropDuplicates(["event_id"])
    size = finite("executed_notional")
    return events.select("event_id", F.col("bond_id").alias("bond"), "issuer_id", micros("prediction_timestamp").alias("us"), F.col("customer_side").alias("side"), size.alias("size"), "source", "executed", "firmed_up", "responded", "side_valid", finite("response_latency_ms").alias("latency"), finite("quoted_spread").alias("quoted_spread"))


_GRID = """WITH grid AS (SELECT DISTINCT ON (event_id) event_id, bond_id AS bond, issuer_id, epoch_us(prediction_timestamp) AS us, customer_side AS side, CASE WHEN NOT isnan(executed_notional) THEN executed_notional END AS size,
 source, executed, firmed_up, responded, side_valid, CASE WHEN NOT isnan(response_latency_ms) THEN response_latency_ms END AS latency FROM label_events WHERE event_id IS NOT NULL AND bond_id IS NOT NULL AND prediction_timestamp IS NOT NULL)"""


def _both(where: str, hours: dict[str, int], aggregates: dict[str, str], counts: tuple[int, ...] = COUNTS) -> str:
    """Aggregates (over s) of a source in calendar windows and in the last n events, one common table each."""
    parts = []
    for name, width in hours.items():
        parts.append(f"w_{name} AS (SELECT g.event_id, {', '.join(f'{a} AS {n}_{name}' for n, a in aggregates.items())} FROM (SELECT event_id, bond, us FROM grid) g JOIN stream s ON s.bond = g.bond AND s.us >= g.us - {width} AND s.us < g.us GROUP BY g.event_id)")
    for n_ in counts:
        parts.append(
            f"w_last_{n_} AS (SELECT event_id, {', '.join(f'{a} AS {n}_last_{n_}' for n, a in aggregates.items())} FROM (SELECT g.event_id, s.* EXCLUDE (event_id), s.event_id AS sid, row_number() OVER (PARTITION BY g.event_id ORDER BY s.us DESC, s.event_id DESC) AS k"
            f" FROM grid g JOIN stream s ON s.bond = g.bond AND s.us < g.us) s WHERE k <= {n_} GROUP BY event_id)"
        )
    return f"{_GRID}, stream AS (SELECT * FROM grid WHERE {where}), " + ", ".join(parts)


def _names() -> list[str]:
    return [*WINDOWS, *[f"last_{n}" for n in COUNTS]]


def _imbalances_sql(where: str) -> str:
    sums = {"b": "sum(CASE WHEN side = 1 THEN 1 ELSE 0 END)", "s": "sum(CASE WHEN side = -1 THEN 1 ELSE 0 END)"}
    columns = ", ".join(f"CASE WHEN b_{w} + s_{w} > 0 THEN round((b_{w} - s_{w}) / (b_{w} + s_{w} + 1e-9), 6) END AS imbalance_{w}, CAST(coalesce(b_{w} + s_{w}, 0) AS BIGINT) AS count_{w}" for w in _names())
    joins = " ".join(f"LEFT JOIN w_{w} ON w_{w}.event_id = g.event_id" for w in _names())
    return _both(where, WINDOWS, sums) + f" SELECT g.event_id, {columns} FROM grid g {joins}"


def _a1(source: str):
    where = f"{SOURCES[source]} AND side IN (-1, 1)"

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = grid(spark, d)
        stream, sums = rows.where(where), A.side_sums("side")
        out = A.calendar_sums(rows, stream, "bond", "us", "event_id", sums, WINDOWS).drop("bond", "us")
        out = out.join(A.event_sums(rows, stream, "bond", "us", "event_id", sums, ["event_id"], COUNTS), "event_id")
        columns = []
        for w in _names():
            buy, sell = F.col(f"buy_{w}"), F.col(f"sell_{w}")
            columns += [F.round(A.imbalance(buy, sell), 6).alias(f"imbalance_{w}"), (F.coalesce(buy, F.lit(0.0)) + F.coalesce(sell, F.lit(0.0))).cast("long").alias(f"count_{w}")]
        return out.select("event_id", *columns)

    run.__name__, run.__doc__ = f"a1_{source}", f"Count imbalance of {source} in two calendar windows and two event windows."
    QUERIES[run.__name__], SQL[run.__name__] = run, _imbalances_sql(where)


for _source in SOURCES:
    _a1(_source)


_KINDS = {"raw": "size", "log": "ln(1 + greatest(size, 0))", "sqrt": "sqrt(greatest(size, 0))"}


@query(
    _both("executed AND side IN (-1, 1)", WINDOWS, {f"{s}_{k}": f"sum(CASE WHEN side = {v} THEN {e} END)" for k, e in _KINDS.items() for s, v in (("b", 1), ("s", -1))})
    + " SELECT g.event_id, "
    + ", ".join(f"CASE WHEN coalesce(b_{k}_{w}, 0) + coalesce(s_{k}_{w}, 0) > 0 THEN round((coalesce(b_{k}_{w}, 0) - coalesce(s_{k}_{w}, 0)) / (coalesce(b_{k}_{w}, 0) + coalesce(s_{k}_{w}, 0) + 1e-9), 5) END AS {k}_{w}" for k in _KINDS for w in _names())
    + " FROM grid g " + " ".join(f"LEFT JOIN w_{w} ON w_{w}.event_id = g.event_id" for w in _names())
)
def a2_executions(spark: SparkSession, d: str) -> DataFrame:
    """Notional imbalance of executions by three transforms of size, in calendar and event windows."""
    rows = grid(spark, d)
    stream = rows.where("executed AND side IN (-1, 1)")
    sums = {k: c for kind in _KINDS for k, c in A.side_sums("side", A.transformed(F.col("size"), kind), f"_{kind}").items()}
    out = A.calendar_sums(rows, stream, "bond", "us", "event_id", sums, WINDOWS).drop("bond", "us")
    out = out.join(A.event_sums(rows, stream, "bond", "us", "event_id", sums, ["event_id"], COUNTS), "event_id")
    return out.select("event_id", *[F.round(A.imbalance(F.col(f"buy_{k}_{w}"), F.col(f"sell_{k}_{w}")), 5).alias(f"{k}_{w}") for k in _KINDS for w in _names()])


@query(
    _GRID
    + """, s AS (SELECT g.event_id, sum(exp(-0.6931471805599453 * (g.us - x.us) / 8.64e10)) FILTER (x.side = 1) / 86400 AS b, sum(exp(-0.6931471805599453 * (g.us - x.us) / 8.64e10)) FILTER (x.side = -1) / 86400 AS l
      FROM grid g LEFT JOIN grid x ON x.bond = g.bond AND x.us < g.us AND x.source = 'rfq' AND x.side IN (-1, 1) GROUP BY g.event_id)
    SELECT event_id, CAST(format('{:.7e}', b) AS DOUBLE) AS buy_intensity, CAST(format('{:.7e}', l) AS DOUBLE) AS sell_intensity, CAST(format('{:.6e}', (b + 1e-9) / (l + 1e-9)) AS DOUBLE) AS intensity_ratio FROM s"""
)
def a3_requests(spark: SparkSession, d: str) -> DataFrame:
    """Decayed buy and sell intensity of requests over all of the bond's history, and their ratio; half-life a day."""
    rows = grid(spark, d)
    asked = F.col("source") == "rfq"
    out = W.decayed_history(rows, "bond", "us", DAY, {"b": F.when(asked & (F.col("side") == 1), 1.0), "l": F.when(asked & (F.col("side") == -1), 1.0)})
    digits = lambda c, n: F.when(c.isNotNull(), F.format_string(f"%.{n}e", c).cast("double"))
    ratio = (F.col("b") + 1e-9) / (F.col("l") + 1e-9)
    return out.select("event_id", digits(F.col("b"), 7).alias("buy_intensity"), digits(F.col("l"), 7).alias("sell_intensity"), digits(ratio, 6).alias("intensity_ratio"))


_LAST = """, seq AS (SELECT g.event_id, g.us AS t, s.us, s.side, row_number() OVER (PARTITION BY g.event_id ORDER BY s.us DESC, s.event_id DESC) AS k FROM grid g JOIN stream s ON s.bond = g.bond AND s.us < g.us),
 f AS (SELECT event_id, any_value(t) AS t, max(side) FILTER (k = 1) AS last FROM seq GROUP BY event_id),
 r AS (SELECT seq.*, f.last, min(CASE WHEN side != last THEN k END) OVER (PARTITION BY seq.event_id) AS turned, lead(side) OVER (PARTITION BY seq.event_id ORDER BY k) AS older FROM seq JOIN f USING (event_id))
 SELECT event_id, any_value(last) AS last_side, CAST(coalesce(min(turned) - 1, count(*)) AS BIGINT) AS same_side_run_length, round((any_value(t) - max(us) FILTER (side != last)) / 1e6, 3) AS elapsed_seconds_since_side_change,
 round(avg(CAST(side = last AS INT)) FILTER (k <= 10), 6) AS fraction_same_last_10, CASE WHEN count(*) > 1 THEN round((count(*) FILTER (k < 10 AND older != side)) / (least(count(*), 10) - 1 + 1e-9), 6) END AS switching_hazard_last_10 FROM r GROUP BY event_id"""


@query(f"{_GRID}, stream AS (SELECT * FROM grid WHERE source = 'rfq' AND side IN (-1, 1)), found AS (WITH x AS (SELECT 1){_LAST}) SELECT g.event_id, last_side, same_side_run_length, elapsed_seconds_since_side_change, fraction_same_last_10, switching_hazard_last_10 FROM grid g LEFT JOIN found ON found.event_id = g.event_id")
def a4_requests(spark: SparkSession, d: str) -> DataFrame:
    """Last side of the bond's requests, its run, the time since the other side, and sameness and switching in the last ten."""
    rows = grid(spark, d)
    out = A.persistence(rows, rows.where("source = 'rfq'"), "bond", "us", "event_id", "side", ["event_id"], [10])
    return out.select("event_id", "last_side", "same_side_run_length", F.round("elapsed_seconds_since_side_change", 3).alias("elapsed_seconds_since_side_change"), *[F.round(c, 6).alias(c) for c in ("fraction_same_last_10", "switching_hazard_last_10")])


_LEVELS = (("bond",), ("issuer_id",), ("liquidity_bucket",), ("hour",))


@query()
def a5_surprise(spark: SparkSession, d: str) -> DataFrame:
    """A day's requests of the bond against what the first 60 % of times had: by bond, else issuer, liquidity bucket or hour."""
    rows = grid(spark, d)
    seen = A.calendar_sums(rows, rows.where("source = 'rfq'"), "bond", "us", "event_id", {}, {"1d": DAY}).select("event_id", F.col("n_1d").cast("double").alias("observed"))
    bonds = table(spark, d, "bonds").select(F.col("bond_id").alias("bond"), "liquidity_bucket")
    hour = (F.floor(F.col("us") / HOUR) % 24).cast("int").alias("hour")
    wide = rows.select("event_id", "bond", "issuer_id", "us", hour).join(seen, "event_id").join(bonds, "bond", "left")
    low, high = wide.agg(F.min("us"), F.max("us")).first()
    base = A.baseline(wide.where(F.col("us") <= (low or 0) + 0.6 * ((high or 0) - (low or 0))), "observed", _LEVELS, 20)
    return rounded(A.surprise(wide, "observed", base, _LEVELS).select("event_id", "observed", "expected", "scale", "surprise"), "event_id", digits=6)


@query(
    """WITH grid AS (SELECT DISTINCT ON (event_id) event_id, upper(trim(bond_id)) AS bond, epoch_us(prediction_timestamp) AS us FROM label_events WHERE event_id IS NOT NULL AND bond_id IS NOT NULL AND prediction_timestamp IS NOT NULL),
    q AS (SELECT DISTINCT upper(trim(bond_id)) AS bond, epoch_us(source_event_time) AS us, bid, ask, mid, spread FROM composite_snapshots WHERE bond_id IS NOT NULL AND mid IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL AND spread IS NOT NULL),
    l AS (SELECT g.event_id AS k, g.us - q.us AS age, q.* FROM grid g JOIN q ON q.bond = g.bond AND q.us < g.us QUALIFY row_number() OVER (PARTITION BY g.event_id ORDER BY q.us DESC, bid DESC, ask DESC, mid DESC, spread DESC) = 1)
    SELECT event_id, round(spread, 6) AS spread, round(mid, 6) AS mid, round((ask + bid - 2 * mid) / (abs(mid) + 1e-9), 9) AS asymmetry, round(age / 1e6, 3) AS staleness_seconds FROM grid LEFT JOIN l ON k = event_id"""
)
def a6_quote_state(spark: SparkSession, d: str) -> DataFrame:
    """The last composite strictly before each event: spread, mid, asymmetry and staleness."""
    bond = F.upper(F.trim("bond"))
    quotes = table(spark, d, "composite_snapshots").where("mid IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL AND spread IS NOT NULL")
    quotes = quotes.select(F.upper(F.trim("bond_id")).alias("bond"), micros("source_event_time").alias("us"), "bid", "ask", "mid", "spread").distinct()
    out = A.quote_state(grid(spark, d).withColumn("bond", bond), quotes, "bond", "us", "event_id")
    return out.select("event_id", F.round("spread", 6).alias("spread"), F.round("mid", 6).alias("mid"), F.round("asymmetry", 9).alias("asymmetry"), F.round("staleness_seconds", 3).alias("staleness_seconds"))


@query(
    _both("executed AND side IN (-1, 1)", {}, {"b": "sum(CASE WHEN side = 1 THEN abs(size) END)", "s": "sum(CASE WHEN side = -1 THEN abs(size) END)", "k": "count(size)"}, (5,))
    + """, q AS (SELECT DISTINCT bond_id AS bond, epoch_us(source_event_time) AS us, bid, ask, mid, spread FROM composite_snapshots WHERE bond_id IS NOT NULL AND mid IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL AND spread IS NOT NULL),
    l AS (SELECT g.event_id AS k, (g.us - q.us) / 1e6 AS age, q.spread FROM grid g JOIN q ON q.bond = g.bond AND q.us < g.us QUALIFY row_number() OVER (PARTITION BY g.event_id ORDER BY q.us DESC, bid DESC, ask DESC, mid DESC, spread DESC) = 1),
    f AS (SELECT event_id, CASE WHEN k_last_5 > 0 THEN (coalesce(b_last_5, 0) - coalesce(s_last_5, 0)) / (coalesce(b_last_5, 0) + coalesce(s_last_5, 0) + 1e-9) END AS flow FROM w_last_5)
    SELECT g.event_id, round(flow, 6) AS flow_pressure, round(flow * spread, 6) AS flow_x_spread, round(flow * age, 2) AS flow_x_staleness FROM grid g LEFT JOIN f ON f.event_id = g.event_id LEFT JOIN l ON l.k = g.event_id"""
)
def a6_flow(spark: SparkSession, d: str) -> DataFrame:
    """Flow of the last five executions, and its products with the last composite's spread and staleness."""
    rows = grid(spark, d)
    size = F.abs("size")
    sums = {**A.side_sums("side", size), "known": F.col("size").isNotNull().cast("double")}
    flow = A.event_sums(rows, rows.where("executed AND side IN (-1, 1)"), "bond", "us", "event_id", sums, ["event_id"], [5])
    buy, sell = F.col("buy_last_5"), F.col("sell_last_5")
    flow = flow.select("event_id", F.when(F.col("known_last_5") > 0, (buy - sell) / (buy + sell + A.EPSILON)).alias("flow"))
    quotes = table(spark, d, "composite_snapshots").where("bond_id IS NOT NULL AND mid IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL AND spread IS NOT NULL")
    quotes = quotes.select(F.col("bond_id").alias("bond"), micros("source_event_time").alias("us"), "bid", "ask", "mid", "spread").distinct()
    out = flow.join(A.quote_state(rows, quotes, "bond", "us", "event_id"), "event_id")
    return out.select("event_id", F.round("flow", 6).alias("flow_pressure"), F.round(F.col("flow") * F.col("spread"), 6).alias("flow_x_spread"), F.round(F.col("flow") * F.col("staleness_seconds"), 2).alias("flow_x_staleness"))


_RATES = {"no_response": "NOT responded", "firm_up": "firmed_up", "execution": "executed"}


@query(
    _both("source = 'rfq'", {"3d": 3 * DAY}, {**{f"{n}_y": f"sum(CAST({e} AS INT))" for n, e in _RATES.items()}, **{f"{n}_k": f"count({e})" for n, e in _RATES.items()}, "ms": "avg(latency)", "n": "count(*)"}, (25,))
    + " SELECT g.event_id, "
    + ", ".join([f"CASE WHEN {n}_k_{w} > 0 THEN round({n}_y_{w} / ({n}_k_{w} + 1e-9), 6) END AS {n}_rate_{w}" for n in _RATES for w in ("3d", "last_25")] + [f"round(ms_{w}, 4) AS mean_latency_{w}, CAST(coalesce(n_{w}, 0) AS BIGINT) AS n_{w}" for w in ("3d", "last_25")])
    + " FROM grid g LEFT JOIN w_3d ON w_3d.event_id = g.event_id LEFT JOIN w_last_25 ON w_last_25.event_id = g.event_id"
)
def a16_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of no response, firm-up and execution, and mean latency, of the bond's requests in three days and in the last 25."""
    rows = grid(spark, d)
    stream = rows.where("source = 'rfq'")
    sums = {**A.rate_sums({n: F.expr(e) for n, e in _RATES.items()}), "latency": F.col("latency"), "latencies": F.col("latency").isNotNull().cast("double")}
    out = A.calendar_sums(rows, stream, "bond", "us", "event_id", sums, {"3d": 3 * DAY}).drop("bond", "us")
    out = out.join(A.event_sums(rows, stream, "bond", "us", "event_id", sums, ["event_id"], [25]), "event_id")
    columns = [F.round(A.rate(n, w), 6).alias(f"{n}_rate_{w}") for n in _RATES for w in ("3d", "last_25")]
    for w in ("3d", "last_25"):
        columns += [F.round(F.when(F.col(f"latencies_{w}") > 0, F.col(f"latency_{w}") / F.col(f"latencies_{w}")), 4).alias(f"mean_latency_{w}"), F.col(f"n_{w}").cast("long").alias(f"n_{w}")]
    return out.select("event_id", *columns)


@query(
    """WITH e AS (SELECT DISTINCT ON (event_id) customer_side AS side, CASE WHEN NOT isnan(executed_notional) THEN executed_notional END AS size FROM label_events WHERE event_id IS NOT NULL AND bond_id IS NOT NULL AND prediction_timestamp IS NOT NULL),
    t AS (SELECT 'count' AS measure, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS buy_total, CAST(count(*) FILTER (side = -1) AS DOUBLE) AS sell_total FROM e
      UNION ALL SELECT 'notional', sum(greatest(size, 0)) FILTER (side = 1), sum(greatest(size, 0)) FILTER (side = -1) FROM e)
    SELECT measure, round(buy_total, 2) AS buy_total, round(sell_total, 2) AS sell_total, round((buy_total + sell_total) / (2 * buy_total), 9) AS buy_weight, round((buy_total + sell_total) / (2 * sell_total), 9) AS sell_weight, 'inverse_market_share' AS method FROM t"""
)
def a1_side_weights(spark: SparkSession, d: str) -> DataFrame:
    """The fit of the weighted imbalance: what makes both sides count alike."""
    out = A.side_weights(grid(spark, d), "us", "side", {"count": F.lit(1.0), "notional": F.col("size")})
    return out.select("measure", F.round("buy_total", 2).alias("buy_total"), F.round("sell_total", 2).alias("sell_total"), F.round("buy_weight", 9).alias("buy_weight"), F.round("sell_weight", 9).alias("sell_weight"), "method")
