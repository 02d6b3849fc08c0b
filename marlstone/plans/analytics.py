"""Queries of labels, portfolios, profit and loss, evaluation, clocks and triplets, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import evaluation, labels, pnl, portfolio, triplets
from marlstone.operators.skew import weighted_percentiles
from marlstone.plans.factors import _SCORED, _scored
from marlstone.plans.reference import DAILY, TAPE, daily, rounded
from marlstone.sources import policy, sinks
from marlstone.sources.tables import table
from marlstone.sources.tape import tape

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_ENDS = {
    "now": "t", "30m": "t + INTERVAL 30 MINUTE", "2h": "t + INTERVAL 2 HOUR",
    "1bd": "t + to_days(CAST(CASE isodow(t) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INT))", "5bd": "t + to_days(CAST(CASE isodow(t) WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 7 END AS INT))",
}
_LABELS = (
    """WITH facts AS (SELECT DISTINCT bond_id, fair_value_id, fair_value, oas, duration, effective_time AS e, coalesce(publication_time, effective_time) AS p, coalesce(revision_time, publication_time, effective_time) AS r
  FROM fair_values WHERE fair_value IS NOT NULL AND NOT isnan(fair_value) AND bond_id IS NOT NULL AND effective_time IS NOT NULL),
base AS (SELECT DISTINCT ON (event_id) event_id, bond_id, prediction_timestamp AS t, customer_side AS s, executed_notional AS q, execution_price AS x FROM label_events WHERE event_id IS NOT NULL AND bond_id IS NOT NULL AND prediction_timestamp IS NOT NULL),
asked AS ("""
    + " UNION ALL ".join(f"SELECT event_id, bond_id, '{h}' AS h, {end} AS a FROM base" for h, end in _ENDS.items())
    + """), found AS (SELECT event_id, h, a, facts.* EXCLUDE (bond_id) FROM asked JOIN facts ON asked.bond_id = facts.bond_id AND e <= a AND p <= a AND r <= a
  QUALIFY row_number() OVER (PARTITION BY event_id, h ORDER BY e DESC, p DESC, r DESC, fair_value_id DESC) = 1)
SELECT b.event_id, b.bond_id"""
    + "".join(
        f""", round(CASE WHEN {k} THEN f{h}.fair_value - n.fair_value END, 6) AS price_target_{h}, NOT coalesce({k}, false) AS label_censored_{h},
  round(CASE WHEN {k} THEN -n.duration * (f{h}.oas - n.oas) END, 6) AS oas_price_equivalent_{h}, round(CASE WHEN s IN (-1, 1) AND {k} THEN s * (f{h}.fair_value - n.fair_value) END, 6) AS signed_move_{h},
  CASE WHEN s IN (-1, 1) AND {k} THEN CAST(s * (f{h}.fair_value - n.fair_value) > 0 AS INT) END AS aggressive_{h}, round(sign(-s * coalesce(q, 0)) * (f{h}.fair_value - x), 6) AS dealer_markout_{h},
  CAST(sign(-s * coalesce(q, 0)) * (f{h}.fair_value - x) < 0 AS INT) AS dealer_toxic_{h}"""
        for h in ("30m", "2h", "1bd", "5bd") for k in (f"(n.fair_value IS NOT NULL AND f{h}.fair_value IS NOT NULL AND f{h}.a - f{h}.e <= INTERVAL 2 DAY)",)
    )
    + " FROM base b LEFT JOIN found n ON n.event_id = b.event_id AND n.h = 'now'"
    + "".join(f" LEFT JOIN found f{h} ON f{h}.event_id = b.event_id AND f{h}.h = '{h}'" for h in ("30m", "2h", "1bd", "5bd"))
)


@query(_LABELS)
def label_targets(spark: SparkSession, d: str) -> DataFrame:
    """Price, spread and markout labels at four horizons, two of them in business days."""
    return rounded(labels.targets(table(spark, d, "label_events"), table(spark, d, "fair_values")), "event_id", "bond_id", digits=6)


@query(
    """WITH base AS (SELECT DISTINCT ON (event_id) event_id, bond_id, prediction_timestamp AS t FROM label_events WHERE event_id IS NOT NULL AND bond_id IS NOT NULL AND prediction_timestamp IS NOT NULL),
    s AS (SELECT DISTINCT event_id, bond_id, prediction_timestamp AS t, customer_side AS side FROM label_events WHERE source = 'trace' AND side_valid AND event_id IS NOT NULL AND prediction_timestamp IS NOT NULL)
    SELECT b.event_id, x.side AS next_trace_side, epoch_us(x.t - b.t) / 1e6 AS time_to_next_trace_seconds FROM base b
    LEFT JOIN (SELECT b.event_id AS k, s.t, s.side FROM base b JOIN s ON b.bond_id = s.bond_id AND s.t > b.t QUALIFY row_number() OVER (PARTITION BY b.event_id ORDER BY s.t, s.event_id) = 1) x ON x.k = b.event_id"""
)
def label_next_trace(spark: SparkSession, d: str) -> DataFrame:
    """The first side-valid trade on the bond strictly after each event."""
    events = table(spark, d, "label_events")
    base = events.where("event_id IS NOT NULL AND bond_id IS NOT NULL AND prediction_timestamp IS NOT NULL").dropDuplicates(["event_id"])
    return labels.next_event(base, events.where("source = 'trace' AND side_valid"), "trace")


_RANKED = DAILY + """, v AS (SELECT bond, day, flow, price, volume, row_number() OVER (PARTITION BY day ORDER BY flow, bond) AS r, count(*) OVER (PARTITION BY day) AS n FROM daily)"""


@query(_RANKED + " SELECT bond, day, round(CASE WHEN n < 2 THEN 0 WHEN r <= n // 2 THEN -1.0 / (n // 2) WHEN r > n - n // 2 THEN 1.0 / (n // 2) ELSE 0 END, 8) AS weight FROM v")
def portfolio_rank_long_short(spark: SparkSession, d: str) -> DataFrame:
    """The day's lower half of flows short, its upper half long, in equal parts."""
    return daily(spark, d).select("bond", "day", F.round(portfolio.rank_long_short(F.col("flow"), ["day"], ["bond"]), 8).alias("weight"))


@query(
    _RANKED
    + """, x AS (SELECT bond, day, price AS risk, CASE WHEN n < 2 THEN 0 WHEN r <= n // 2 THEN -0.5 / (n // 2) WHEN r > n - n // 2 THEN 0.5 / (n // 2) ELSE 0 END AS exposure FROM v),
    p AS (SELECT bond, day, risk, greatest(-0.001, least(0.001, exposure / risk)) AS position FROM x), g AS (SELECT *, sum(abs(position * risk)) OVER (PARTITION BY day) AS gross FROM p)
    SELECT bond, day, round(position, 9) AS target_position, round(position * risk, 8) AS target_exposure, round(gross, 8) AS realized_gross_exposure, round(CASE WHEN gross > 0 THEN position * risk / gross ELSE 0 END, 8) AS target_weight,
    CASE WHEN gross <= 0 THEN 'flat_after_scaling' ELSE 'ok' END AS portfolio_quality_flag FROM g"""
)
def portfolio_target_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions from ranked flows, with the price as the risk unit and a cap on each."""
    out = portfolio.target_positions(daily(spark, d), signal="flow", instrument="bond", groups=["day"], risk="price", cap=0.001)
    return out.select(
        "bond", "day", F.round("target_position", 9).alias("target_position"), *[F.round(c, 8).alias(c) for c in ("target_exposure", "realized_gross_exposure", "target_weight")], "portfolio_quality_flag"
    )


@query(
    _RANKED
    + """, w AS (SELECT *, sign(flow) / nullif(volume, 0) AS iv, flow / nullif(sum(abs(flow)) OVER (PARTITION BY day), 0) AS sp FROM v),
    x AS (SELECT *, coalesce(iv, 0) / nullif(sum(abs(coalesce(iv, 0))) OVER (PARTITION BY day), 0) AS inverse FROM w),
    b AS (SELECT *, sum(sp * price) OVER (PARTITION BY day) / nullif(sum(price * price) OVER (PARTITION BY day), 0) AS shift FROM x)
    SELECT bond, day, round(inverse, 8) AS inverse_volatility, round(sp, 8) AS proportional, CASE WHEN n >= 2 THEN round((CASE WHEN r > (n + 1) / 2 THEN 1 WHEN r < (n + 1) / 2 THEN -1 ELSE 0 END) / (2.0 * (n // 2)), 8) END AS halves,
    round(sp - price * coalesce(shift, 0), 8) AS neutral_weight FROM b"""
)
def portfolio_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a day's flows: by inverse volume, in proportion, in halves, and in proportion made neutral to the price."""
    flow = F.col("flow")
    rows = daily(spark, d).select(
        "bond", "day", "price", portfolio.inverse_volatility(flow, F.col("volume"), ["day"]).alias("inverse_volatility"), portfolio.proportional(flow, ["day"]).alias("proportional"),
        portfolio.rank_halves(flow, ["day"], ["bond"]).alias("halves"),
    )
    return rounded(portfolio.beta_neutral(rows, "proportional", "price", ["day"]).drop("price"), "bond", "day", digits=8)


@query(
    _RANKED
    + """, w AS (SELECT bond, day, CASE WHEN n < 2 THEN 0 WHEN r <= n // 2 THEN -1.0 / (n // 2) WHEN r > n - n // 2 THEN 1.0 / (n // 2) ELSE 0 END AS weight FROM v),
    t AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM daily)), i AS (SELECT bond, k, weight FROM w JOIN t USING (day))
    SELECT i.bond, t.day, round(sum(weight) / 5, 8) AS tranche_weight FROM i JOIN t ON t.k BETWEEN i.k AND i.k + 4 GROUP BY ALL"""
)
def portfolio_tranches(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the last five days' target weights, a day without a bond counting as 0."""
    rows = daily(spark, d).withColumn("weight", portfolio.rank_long_short(F.col("flow"), ["day"], ["bond"]))
    out = portfolio.tranches(rows, "weight", "bond", "day", 5)
    return out.select("bond", "day", F.round("tranche_weight", 8).alias("tranche_weight"))


@query(
    DAILY
    + """, s AS (SELECT bond, day, price - lag(price) OVER (PARTITION BY bond ORDER BY day) AS x FROM daily), e AS (SELECT bond, day, x, sum(x) OVER (PARTITION BY bond ORDER BY day) AS q FROM s WHERE x IS NOT NULL),
    c AS (SELECT *, q - max(q) OVER (PARTITION BY bond ORDER BY day) AS dd, q - min(q) OVER (PARTITION BY bond ORDER BY day) AS ru FROM e)
    SELECT bond, CAST(count(*) AS BIGINT) AS count, round(sum(x), 6) AS total_pnl, round(avg(x), 6) AS mean_pnl, round(stddev_samp(x) * sqrt(252), 6) AS volatility,
    round(CASE WHEN count(*) > 1 AND stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(252) END, 5) AS sharpe_like_ratio,
    round(CASE WHEN sum(CASE WHEN x < 0 THEN -x ELSE 0 END) > 0 THEN sum(CASE WHEN x > 0 THEN x ELSE 0 END) / sum(CASE WHEN x < 0 THEN -x ELSE 0 END) WHEN sum(CASE WHEN x > 0 THEN x ELSE 0 END) > 0 THEN 'inf'::DOUBLE END, 5) AS profit_factor,
    round(avg(CASE WHEN x != 0 THEN CAST(x > 0 AS INT) END), 6) AS win_rate, round(min(dd), 6) AS max_drawdown, round(max(ru), 6) AS max_runup FROM c GROUP BY bond"""
)
def pnl_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per bond, of one unit held from day to day."""
    from pyspark.sql import Window

    rows = daily(spark, d).withColumn("x", F.col("price") - F.lag("price").over(Window.partitionBy("bond").orderBy("day")))
    out = pnl.summary(rows, "x", ["day"], ["bond"], annualization=252)
    return out.select("bond", "count", *[F.round(c, 5 if c in ("sharpe_like_ratio", "profit_factor") else 6).alias(c) for c in out.columns if c not in ("bond", "count")])


_P = _SCORED + ", s AS (SELECT greatest(least(p, 1 - 1e-12), 1e-12) AS p, y FROM e)"


@query(
    _P
    + """, g AS (SELECT p, count(*) AS m, sum(y) AS k FROM s GROUP BY p), c AS (SELECT *, sum(m) OVER (ORDER BY p) - m AS mb, sum(k) OVER (ORDER BY p) - k AS kb, sum(m) OVER () AS n, sum(k) OVER () AS t FROM g),
    b AS (SELECT least(floor(p * 10), 9) AS b, abs(sum(k - p * m)) AS gap FROM g GROUP BY 1)
    SELECT CAST(max(n) AS BIGINT) AS n, CAST(max(t) AS BIGINT) AS positives, round(sum(-(k * ln(p) + (m - k) * ln(1 - p))) / max(n), 7) AS log_loss, round(sum(k * pow(1 - p, 2) + (m - k) * pow(p, 2)) / max(n), 7) AS brier,
    round(sum(k * (mb - kb + (m - k) / 2.0)) / (max(t) * (max(n) - max(t))), 7) AS roc_auc, round(sum(k * (t - kb) / (n - mb)) / max(t), 7) AS pr_auc, round((SELECT sum(gap) FROM b) / max(n), 7) AS ece,
    CAST(coalesce(sum(m - k) FILTER (p < 0.5), 0) AS BIGINT) AS tn, CAST(coalesce(sum(m - k) FILTER (p >= 0.5), 0) AS BIGINT) AS fp, CAST(coalesce(sum(k) FILTER (p < 0.5), 0) AS BIGINT) AS fn, CAST(coalesce(sum(k) FILTER (p >= 0.5), 0) AS BIGINT) AS tp FROM c"""
)
def metric_binary(spark: SparkSession, d: str) -> DataFrame:
    """Loss, areas, calibration error and confusion of the quoted spread as a probability of winning."""
    out = evaluation.binary_metrics(_scored(spark, d), "p", "y")
    return out.select("n", "positives", *[F.round(c, 7).alias(c) for c in ("log_loss", "brier", "roc_auc", "pr_auc", "ece")], "tn", "fp", "fn", "tp")


@query(
    _SCORED
    + """, r AS (SELECT p, y, row_number() OVER (ORDER BY p, event_id) AS r, count(*) OVER () AS n FROM e)
    SELECT CAST(greatest(ceil((r - 1) * 10 / greatest(n - 1, 1)), 1) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS row_count, round(avg(p), 7) AS mean_probability, round(avg(y), 7) AS event_rate FROM r GROUP BY 1"""
)
def metric_deciles(spark: SparkSession, d: str) -> DataFrame:
    """Rates by decile of score rank."""
    return rounded(evaluation.deciles(_scored(spark, d), "p", "y", ["event_id"]), "bucket", digits=7)


@query(
    """WITH e AS (SELECT DISTINCT event_id, quoted_spread AS x, response_latency_ms AS z, realized_edge AS y FROM label_events WHERE event_id IS NOT NULL AND NOT isnan(quoted_spread) AND NOT isnan(response_latency_ms) AND NOT isnan(realized_edge)),
    m AS (SELECT count(*) AS n, covar_pop(x, x) * count(*) + 1 AS xx, covar_pop(z, z) * count(*) + 1 AS zz, covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM e),
    w AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM m)
    SELECT 'quoted_spread' AS feature, round(a, 6) AS weight FROM w UNION ALL SELECT 'response_latency_ms', round(b, 6) FROM w UNION ALL SELECT 'intercept', round(my - a * mx - b * mz, 6) FROM w"""
)
def model_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Realised edge on quoted spread and latency, from Gram sums."""
    rows = table(spark, d, "label_events").where("event_id IS NOT NULL").select("event_id", "quoted_spread", "response_latency_ms", "realized_edge").distinct()
    weights = evaluation.ridge(rows, ["quoted_spread", "response_latency_ms"], "realized_edge")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in weights.items()], "feature string, weight double")


@query(TAPE + " SELECT CAST(r // 500 - 1 AS INT) AS clock_index, us FROM (SELECT us, row_number() OVER (ORDER BY us, id) AS r FROM tape) WHERE r % 500 = 0")
def clock_event(spark: SparkSession, d: str) -> DataFrame:
    """The instant of every 500th event of the whole tape."""
    return triplets.event_clock(tape(spark, d), "us", 500, ["id"])


@query(
    """WITH RECURSIVE tape AS (SELECT user_id AS bond, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, value AS a FROM events),
    walk AS (SELECT bond, us, r, CASE WHEN a >= 400 THEN 0.0 ELSE a END AS s, CAST(a >= 400 AS INT) AS tick, CAST(a >= 400 AS INT) AS ticks FROM tape WHERE r = 1
      UNION ALL SELECT t.bond, t.us, t.r, CASE WHEN s + a >= 400 THEN 0.0 ELSE s + a END, CAST(s + a >= 400 AS INT), ticks + CAST(s + a >= 400 AS INT) FROM walk w JOIN tape t ON t.bond = w.bond AND t.r = w.r + 1)
    SELECT bond, ticks - 1 AS clock_index, us FROM walk WHERE tick = 1"""
)
def clock_information(spark: SparkSession, d: str) -> DataFrame:
    """Per bond, a tick each time its size since the last tick reaches 400."""
    return triplets.information_clock(tape(spark, d), "bond", "us", "amount", 400.0, ["id"])


_PANEL = DAILY + """, s AS (SELECT bond, round(price, 6) AS price, row_number() OVER (PARTITION BY bond ORDER BY day) AS k FROM daily), g AS (SELECT * FROM (SELECT unnest([1, 3]) AS lag), (SELECT unnest([1, 2]) AS horizon)),
 panel AS (SELECT lag, horizon, a.price - p.price AS x, f.price - a.price AS y FROM g, s a JOIN s p ON p.bond = a.bond AND p.k = a.k - lag JOIN s f ON f.bond = a.bond AND f.k = a.k + horizon),
 r AS (SELECT lag, horizon, rank() OVER (PARTITION BY lag, horizon ORDER BY x) + (count(*) OVER (PARTITION BY lag, horizon, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY lag, horizon ORDER BY y) + (count(*) OVER (PARTITION BY lag, horizon, y) - 1) / 2.0 AS ry FROM panel)"""


def _panel(spark: SparkSession, d: str) -> DataFrame:
    samples = daily(spark, d).select("bond", F.col("day").alias("clock_index"), F.col("day").alias("us"), F.round("price", 6).alias("price"))
    return triplets.panel(samples, "bond", "us", "price", lags=(1, 3), horizons=(1, 2))


@query(_PANEL + " SELECT CAST(lag AS INT) AS lag, CAST(horizon AS INT) AS horizon, round(corr(rx, ry), 7) AS rho, CAST(count(*) AS BIGINT) AS n_obs FROM r GROUP BY ALL")
def triplet_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlations of past and future moves, pooled over bonds, for four lag-horizon pairs."""
    return triplets.estimates(_panel(spark, d)).select("lag", "horizon", F.round("rho", 7).alias("rho"), "n_obs")


@query()
def triplet_signal(spark: SparkSession, d: str) -> DataFrame:
    """Signals of the candidates that hold after adjustment, from ranks frozen at the first 70 % of days."""
    rows = evaluation.chronological(_panel(spark, d), "us", 0.7, 0.0)
    train = rows.where("split = 'train'")
    chosen = triplets.selected(triplets.adjusted(triplets.estimates(train)), alpha=1.0, least=3)
    return triplets.aggregated(triplets.scores(rows, chosen, train, "bond"), "bond")


@query(
    """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (event_id IS NULL) AS BIGINT) AS null_keys, CAST(count(*) FILTER (event_id IS NOT NULL) - count(DISTINCT event_id) AS BIGINT) AS repeats,
    CAST(count(*) FILTER (side IS NULL OR side NOT IN (-1, 1)) AS BIGINT) AS bad_sides, CAST(count(*) FILTER (NOT coalesce(notional > 0 AND NOT isnan(notional), false)) AS BIGINT) AS bad_notional FROM source_events"""
)
def profile_structure(spark: SparkSession, d: str) -> DataFrame:
    """Rows, repeats and values out of bounds of source_events."""
    return policy.structure(table(spark, d, "source_events"), key="event_id", sides="side", positive=["notional"])


@query(
    "SELECT 'bonds' AS name, column_name, n AS rows, n - k AS nulls, CAST(u AS BIGINT) AS n_distinct FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u FROM bonds" for c in ("bond_id", "issuer_id", "currency", "sector", "rating", "maturity_date", "liquidity_bucket"))
    + ")"
)
def profile_bonds(spark: SparkSession, d: str) -> DataFrame:
    out = policy.profile(table(spark, d, "bonds").select("bond_id", "issuer_id", "currency", "sector", "rating", "maturity_date", "liquidity_bucket"))
    return out.select(F.lit("bonds").alias("name"), "column_name", "rows", "nulls", "n_distinct")


@query()
def table_digest_full(spark: SparkSession, d: str) -> DataFrame:
    """A digest of every column of the trades, the same in any order of rows."""
    return sinks.digest(table(spark, d, "trace_trades"))


@query(
    """WITH t AS (SELECT bond_id, issuer_id, count(*) AS n_trades, min(source_event_time) AS f, max(source_event_time) AS l, quantile_cont(CASE WHEN NOT isnan(notional) THEN notional END, 0.5) AS median_notional
      FROM trace_trades WHERE bond_id IS NOT NULL AND issuer_id IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n_trades, bond_id, issuer_id) AS k, count(*) OVER () AS n FROM t)
    SELECT bond_id, issuer_id, CAST(n_trades AS BIGINT) AS n_trades, epoch_us(f) AS first_us, epoch_us(l) AS last_us, round(median_notional, 4) AS median_notional,
    CASE WHEN ceil((k - 1) * 3 / greatest(n - 1, 1)) <= 1 THEN 'low' WHEN ceil((k - 1) * 3 / greatest(n - 1, 1)) = 2 THEN 'medium' ELSE 'high' END AS liquidity FROM r"""
)
def dimension_bonds(spark: SparkSession, d: str) -> DataFrame:
    """Bonds from their trades: counts, first and last, median size (from weighted values, so no bond is one task), terciles of activity."""
    from pyspark.sql import Window

    trades = table(spark, d, "trace_trades").where("bond_id IS NOT NULL AND issuer_id IS NOT NULL")
    us = F.unix_micros("source_event_time")
    freq = trades.groupBy("bond_id", "issuer_id", "notional").agg(F.count(F.lit(1)).alias("freq"), F.min(us).alias("f"), F.max(us).alias("l"))
    per = freq.groupBy("bond_id", "issuer_id").agg(F.sum("freq").alias("n_trades"), F.min("f").alias("first_us"), F.max("l").alias("last_us"))
    middle = weighted_percentiles(freq, ["bond_id", "issuer_id"], "notional", {"median_notional": 0.5})
    k, n = F.row_number().over(Window.orderBy("n_trades", "bond_id", "issuer_id")), F.count(F.lit(1)).over(Window.partitionBy())  # over bonds, not trades
    third = F.ceil((k - 1) * 3 / F.greatest(n - 1, F.lit(1)))
    name = F.when(third <= 1, "low").when(third == 2, "medium").otherwise("high")
    return per.join(middle, ["bond_id", "issuer_id"], "left").withColumn("liquidity", name).withColumn("median_notional", F.round("median_notional", 4))
