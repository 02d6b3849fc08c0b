"""Queries and SQL of the problems on language-model data and algorithms (p2, p6, p8, p9, p10), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import leaks, mixing, nearest, pii, sketch
from marlstone.operators.rolling import once
from marlstone.session import shared_checkpoint
from marlstone.sources.tables import micros, plain_id, table


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "trace_trades").where("price IS NOT NULL AND NOT isnan(price)")
    quotes = table(spark, d, "composite_snapshots").where("mid IS NOT NULL AND NOT isnan(mid)")
    return nearest.nearest(
        trades,
        quotes,
        entity=plain_id("bond_id"),
        left_id="trade_id",
        left_us=micros("source_event_time"),
        right_id="snapshot_id",
        right_us=micros("source_event_time"),
        tolerance_us=300_000_000,
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select("snapshot_id", "trade_id")


def p2_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Trades matched by minutes from the snapshot, negative before it."""
    return _nearest(spark, d).groupBy(F.floor(F.col("gap_us") / 60_000_000).alias("minute")).agg(F.count(F.lit(1)).alias("trades"))


PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Distinct events with their day; those without a time make a day of their own."""
    day = F.coalesce(F.date_format("timestamp_utc", "yyyy-MM-dd"), F.lit("none")).alias("day")
    return once(table(spark, d, "source_events"), "event_id", "source_bond_id", "notional", day)


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per bond and day, and per bond over all days: sketches of single days, inverted, and added up and inverted."""
    days = sketch.build(_events(spark, d), ["source_bond_id", "day"], "notional")
    both = days.unionByName(sketch.merge(days.drop("day")).withColumn("day", F.lit("all")))
    return sketch.percentiles(both, PERCENTILES)


def p6_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The form that can be combined: each bond's and day's cells."""
    return sketch.build(_events(spark, d), ["source_bond_id", "day"], "notional")


def p6_violations(spark: SparkSession, d: str) -> DataFrame:
    """Per bond, how many percentiles of the merged sketches lie outside their bound, and the largest error of rank beyond
    the encoding's: ranks are counted over all events, reduced to distinct notionals first."""
    events = _events(spark, d).where("source_bond_id IS NOT NULL AND notional IS NOT NULL AND NOT isnan(notional)")
    merged = sketch.percentiles(sketch.merge(sketch.build(events, ["source_bond_id", "day"], "notional").drop("day")), PERCENTILES)
    values = events.groupBy("source_bond_id", "notional").agg(F.count(F.lit(1)).alias("freq")).join(merged, "source_bond_id")
    slack = lambda p: F.col("value_error") * (1 + F.abs(p)) * 1.000001
    counts = [
        F.sum(F.when(condition, F.col("freq")).otherwise(0)).alias(f"{side}_{p}")
        for p in PERCENTILES for side, condition in (("under", F.col("notional") < F.col(p) - slack(p)), ("upto", F.col("notional") <= F.col(p) + slack(p)))
    ]
    ranks = values.groupBy("source_bond_id", "n", "rank_error").agg(*counts)
    gap = lambda p, q: F.greatest((F.col(f"under_{p}") - F.floor(F.col("n") - 1) * q) / F.col("n"), (F.floor((F.col("n") - 1) * q) + 1 - F.col(f"upto_{p}")) / F.col("n"), F.lit(0.0))
    off = F.array(*[gap(p, F.lit(q)) for p, q in PERCENTILES.items()])
    return ranks.withColumn("off", off).select("source_bond_id", "n", F.size(F.filter("off", lambda x: x > F.col("rank_error"))).alias("violations"), F.array_max("off").alias("largest"))


def p6_bounds(spark: SparkSession, d: str) -> DataFrame:
    return p6_violations(spark, d).drop("largest")


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", passage="passage")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents it leaked into, 0 if none."""
    counts = _leaked(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    items = table(spark, d, "eval_items").select("item_id", "suite")
    return items.join(counts, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))


#: Weights over the course of training: scans and notes early, digests and treaties late, the large court feeds nearly evenly.
CURRICULUM = {
    "appeal_portal": ((0.0, 0.9), (1.0, 1.1)),
    "district_feed": ((0.0, 1.1), (1.0, 0.9)),
    "tribunal_bulletin": ((0.0, 1.0), (0.5, 1.2), (1.0, 1.0)),
    "historic_scans": ((0.0, 1.5), (1.0, 0.5)),
    "arbitration_digest": ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    "lay_bench_notes": ((0.0, 2.0), (0.5, 0.5), (1.0, 0.5)),
    "moot_archive": ((0.0, 1.5), (0.3, 1.0), (1.0, 0.6)),
    "treaty_gazette": ((0.0, 0.0), (0.6, 1.0), (1.0, 1.0)),
}


def _mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    sized = shared_checkpoint(mixing.token_counts(docs, doc_id="doc_id", text="text", keep=[F.col("source")]))
    return mixing.mix(sized, table(spark, d, "source_targets"), doc_id="doc_id", source="source", schedules=CURRICULUM)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mix(spark, d), table(spark, d, "source_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"), table(spark, d, "given_names"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its mentions replaced by typed placeholders."""
    return pii.redact(table(spark, d, "documents"), table(spark, d, "given_names"))


QUERIES = {f.__name__: f for f in (p2_found, p2_gaps, p6_percentiles, p6_sketches, p6_violations, p6_bounds, p8_found, p8_report, p9_mix, p9_shares, p10_found, p10_redacted)}

_NEAREST = """
WITH trades AS (
  SELECT DISTINCT trade_id, upper(trim(bond_id)) AS b, epoch_us(source_event_time) AS t FROM trace_trades
  WHERE trade_id IS NOT NULL AND bond_id IS NOT NULL AND price IS NOT NULL AND source_event_time IS NOT NULL
), quotes AS (
  SELECT upper(trim(bond_id)) AS b, epoch_us(source_event_time) AS us, min(snapshot_id) AS snapshot_id FROM composite_snapshots
  WHERE bond_id IS NOT NULL AND mid IS NOT NULL GROUP BY ALL
), best AS (
  SELECT trade_id, snapshot_id, us - t AS gap_us FROM trades JOIN quotes ON trades.b = quotes.b AND us BETWEEN t - 300000000 AND t + 300000000
  QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY abs(us - t), us) = 1
)
"""

_CODES = """
WITH once AS (
  SELECT DISTINCT event_id, source_bond_id, notional AS v, coalesce(strftime(timestamp_utc AT TIME ZONE 'UTC', '%Y-%m-%d'), 'none') AS day FROM source_events
  WHERE event_id IS NOT NULL AND source_bond_id IS NOT NULL AND notional IS NOT NULL AND NOT isnan(notional)
)
"""


def _picked(name: str, q: float) -> str:
    return f"codes[CAST(floor({q} * (len(codes) - 1)) AS BIGINT) + 1] AS c_{name}"


def _decoded(name: str) -> str:
    return f"sign(c_{name}) * CASE WHEN abs(c_{name}) < 1 THEN 0 ELSE pow(2, (abs(c_{name}) + 0.5) / 8192) - 1 END AS {name}"


SQL = {
    # holds while every bond keeps its codes, as at a scale of 0.01; beyond, rank_error is above 0 and p6_bounds holds
    "p6_percentiles": _CODES
    + f""", sizes AS (SELECT *, sign(v) * floor(log2(abs(v) + 1) * 8192) AS c FROM once),
    grouped AS (SELECT source_bond_id, day, list_sort(list(c)) AS codes FROM (SELECT * FROM sizes UNION ALL SELECT * REPLACE ('all' AS day) FROM sizes) GROUP BY ALL),
    picked AS (SELECT source_bond_id, day, CAST(len(codes) AS BIGINT) AS n, {', '.join(_picked(p, q) for p, q in PERCENTILES.items())} FROM grouped)
    SELECT source_bond_id, day, n, {', '.join(map(_decoded, PERCENTILES))}, 0.0::DOUBLE AS rank_error, pow(2, 0.5 / 8192) - 1 AS value_error FROM picked""",
    "p6_bounds": _CODES + "SELECT source_bond_id, CAST(count(*) AS BIGINT) AS n, 0 AS violations FROM once GROUP BY ALL",
    "p2_found": _NEAREST + "SELECT snapshot_id, trade_id FROM best",
    "p2_gaps": _NEAREST + "SELECT CAST(floor(gap_us / 60000000) AS BIGINT) AS minute, count(*) AS trades FROM best GROUP BY ALL",
}
