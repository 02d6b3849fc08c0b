"""Queries and SQL of the general training-data problems (p1, p3, p4, p5, p7), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import asknown, late, replay, rolling, skew
from marlstone.sources.tables import micros, table

CONTENT = ("source", "event_type", "effective_time", "bond_id", "issuer_id", "side", "notional", "price")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(table(spark, d, "market_events"))


def p1_state(spark: SparkSession, d: str) -> DataFrame:
    """The table rebuilt: every event alive with the content of the change that last set it."""
    state = replay.replay(table(spark, d, "market_events"), columns=CONTENT)
    return state.withColumn("effective_time", micros("effective_time")).withColumn("notional", F.nanvl("notional", F.lit(None)))


def p1_patched(spark: SparkSession, d: str) -> DataFrame:
    """The same with partial updates: a column left null by a later set keeps its value."""
    return replay.replay(table(spark, d, "market_events"), columns=("bond_id", "issuer_id", "side"), partial=True)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return late.outcomes(table(spark, d, "trace_trades"))


def p3_revisions(spark: SparkSession, d: str) -> DataFrame:
    return late.triangle(table(spark, d, "trace_trades"))


def _as_known(spark: SparkSession, d: str, columns: tuple[str, ...]) -> DataFrame:
    published = F.coalesce("publication_time", "effective_time")
    values = table(spark, d, "fair_values").where("fair_value IS NOT NULL AND NOT isnan(fair_value)")
    return asknown.as_known(
        table(spark, d, "label_events"),
        values,
        key="bond_id",
        event_id="event_id",
        event_us=micros("prediction_timestamp"),
        clocks=[micros("effective_time"), micros(published), micros(F.coalesce("revision_time", published))],
        attribute_id="fair_value_id",
        columns=columns,
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _as_known(spark, d, ()).select("fair_value_id", "event_id")


def p4_features(spark: SparkSession, d: str) -> DataFrame:
    return _as_known(spark, d, ("fair_value", "oas", "duration")).drop("fair_value_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"source_bond_id": "bond", "source_issuer_id": "issuer"}
    return skew.heavy_keys(table(spark, d, "source_events"), kinds, "event_id", percent=4).select("key_kind", "key_name")


def _statistics(spark: SparkSession, d: str, key: str) -> DataFrame:
    events = rolling.once(table(spark, d, "source_events"), "event_id", key, "notional")
    stats = skew.key_statistics(events, key, "notional", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return stats.select(key, "n_rows", F.round("total", 2).alias("total"), "n_distinct", "mode", *[F.round(p, 4).alias(p) for p in ("p25", "p50", "p75")])


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Per bond: events, notional, distinct notionals, their mode and exact quartiles."""
    return _statistics(spark, d, "source_bond_id")


def p5_issuer_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The same per issuer."""
    return _statistics(spark, d, "source_issuer_id")


def _trailing(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "source_events").where("source_bond_id IS NOT NULL AND timestamp_utc IS NOT NULL")
    amount = F.coalesce(F.nanvl("notional", F.lit(0.0)), F.lit(0.0)).alias("notional")
    day = F.to_date("timestamp_utc").alias("day")
    daily = rolling.once(events, "event_id", "source_bond_id", day, amount).groupBy("source_bond_id", "day").agg(F.sum("notional").alias("notional"), F.count(F.lit(1)).alias("events"))
    return rolling.trailing_totals(daily, entity="source_bond_id", day="day", amount="notional", count="events")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _trailing(spark, d).where("days_before >= 29 AND total_30 > 0 AND 4 * total_7 >= 3 * total_30")
    return rows.select("source_bond_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _trailing(spark, d)
    rounded = [F.round(c, 4).alias(c) for c in ("total_7", "per_day_7", "total_30", "per_day_30")]
    return rows.select("source_bond_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "count_7", "count_30", *rounded)


QUERIES = {
    f.__name__: f for f in (p1_found, p1_state, p1_patched, p3_found, p3_revisions, p4_found, p4_features, p5_found, p5_statistics, p5_issuer_statistics, p7_found, p7_totals)
}

_CHANGES = """
WITH once AS (
  SELECT sequence, event_id, corrected_event_id, coalesce(lower(trim(action)), 'upsert') AS verb, {content}
  FROM market_events GROUP BY ALL
), ops AS (
  SELECT coalesce(corrected_event_id, event_id) AS id, sequence, 0 AS kind, {nulls} FROM once WHERE verb = 'cancel'
  UNION ALL SELECT corrected_event_id, sequence, 0, {nulls} FROM once WHERE verb = 'correction'
  UNION ALL SELECT event_id, sequence, 1, {content} FROM once WHERE verb IN ('upsert', 'correction')
), last AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY sequence DESC, kind DESC) AS r,
         max(CASE WHEN kind = 0 THEN sequence END) OVER (PARTITION BY id) AS removed
  FROM ops WHERE id IS NOT NULL
)
"""


def _changes(columns: str) -> str:
    return _CHANGES.replace("{content}", columns).replace("{nulls}", ", ".join(f"NULL AS {c.strip()}" for c in columns.split(",")))


_KNOWN = """
WITH facts AS (
  SELECT DISTINCT bond_id, fair_value_id, fair_value, oas, duration, effective_time AS e, coalesce(publication_time, effective_time) AS p,
         coalesce(revision_time, publication_time, effective_time) AS r
  FROM fair_values WHERE fair_value IS NOT NULL AND bond_id IS NOT NULL AND effective_time IS NOT NULL
), asked AS (SELECT DISTINCT event_id, bond_id, prediction_timestamp AS t FROM label_events WHERE event_id IS NOT NULL),
best AS (
  SELECT asked.event_id, asked.bond_id, facts.*, row_number() OVER (PARTITION BY asked.event_id ORDER BY e DESC, p DESC, r DESC, fair_value_id DESC) AS k
  FROM asked JOIN facts ON asked.bond_id = facts.bond_id AND e <= t AND p <= t AND r <= t
)
"""

_DAILY = """
WITH once AS (
  SELECT DISTINCT event_id, source_bond_id, CAST(timestamp_utc AT TIME ZONE 'UTC' AS DATE) AS day,
         CASE WHEN notional IS NULL OR isnan(notional) THEN 0 ELSE notional END AS notional
  FROM source_events WHERE source_bond_id IS NOT NULL AND timestamp_utc IS NOT NULL AND event_id IS NOT NULL
), daily AS (SELECT source_bond_id, day, sum(notional) AS notional, count(*) AS n FROM once GROUP BY ALL
), span AS (SELECT source_bond_id, min(day) AS f, max(day) AS l FROM daily GROUP BY ALL
), calendar AS (SELECT source_bond_id, f, CAST(unnest(generate_series(f::TIMESTAMP, l::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM span
), sums AS (
  SELECT c.source_bond_id, c.day, date_diff('day', f, c.day) AS before, coalesce(sum(notional) FILTER (date_diff('day', d.day, c.day) < 7), 0) AS t7,
         coalesce(sum(notional), 0) AS t30, coalesce(sum(n) FILTER (date_diff('day', d.day, c.day) < 7), 0) AS n7, coalesce(sum(n), 0) AS n30
  FROM calendar c LEFT JOIN daily d ON c.source_bond_id = d.source_bond_id AND d.day <= c.day AND d.day > c.day - 30
  GROUP BY ALL
)
"""

_LATE = """
WITH once AS (
  SELECT trade_id, bond_id, source_event_time, notional, date_trunc('hour', source_event_time) AS hour, min(coalesce(receive_time, publication_time)) AS arrival
  FROM trace_trades WHERE trade_id IS NOT NULL GROUP BY ALL
), timed AS (SELECT *, epoch_us(arrival) - epoch_us(hour) - 3600000000 AS late FROM once WHERE arrival IS NOT NULL AND hour IS NOT NULL)
"""

SQL = {
    "p1_found": _changes("source") + "SELECT id AS event_id, sequence FROM last WHERE r = 1 AND kind = 1",
    "p1_state": _changes(", ".join(CONTENT))
    + f"SELECT id AS event_id, sequence, {', '.join(c for c in CONTENT if c not in ('effective_time', 'notional'))}, epoch_us(effective_time) AS effective_time, "
    "CASE WHEN NOT isnan(notional) THEN notional END AS notional FROM last WHERE r = 1 AND kind = 1",
    "p1_patched": _changes("bond_id, issuer_id, side")
    + """SELECT id AS event_id, max(sequence) AS sequence, arg_max(bond_id, sequence) FILTER (bond_id IS NOT NULL) AS bond_id,
         arg_max(issuer_id, sequence) FILTER (issuer_id IS NOT NULL) AS issuer_id, arg_max(side, sequence) FILTER (side IS NOT NULL) AS side
         FROM last WHERE kind = 1 AND sequence >= coalesce(removed, -1) GROUP BY id""",
    "p3_found": _LATE + "SELECT trade_id, CASE WHEN late < 7200000000 THEN 'late_kept' ELSE 'late_dropped' END AS outcome FROM timed WHERE late >= 0",
    "p3_revisions": _LATE
    + """, cells AS (
      SELECT bond_id, hour, CASE WHEN late < 0 THEN 0 ELSE 1 + late // 900000000 END AS revision, count(*) AS n,
             sum(CASE WHEN isnan(notional) THEN 0 ELSE coalesce(notional, 0) END) AS amount
      FROM timed WHERE bond_id IS NOT NULL AND late < 7200000000 GROUP BY ALL
    )
    SELECT bond_id, strftime(hour AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS hour, CAST(revision AS INT) AS revision,
           CAST(sum(n) OVER w AS BIGINT) AS n_trades, round(sum(amount) OVER w, 4) AS notional
    FROM cells WINDOW w AS (PARTITION BY bond_id, hour ORDER BY revision ROWS UNBOUNDED PRECEDING)""",
    "p4_found": _KNOWN + "SELECT fair_value_id, event_id FROM best WHERE k = 1",
    "p4_features": _KNOWN + "SELECT event_id, bond_id, fair_value, oas, duration FROM best WHERE k = 1",
    "p5_found": """
    WITH once AS (SELECT DISTINCT event_id, source_bond_id, source_issuer_id FROM source_events WHERE event_id IS NOT NULL),
    n AS (SELECT 'bond' AS key_kind, source_bond_id AS key_name, count(*) AS c FROM once GROUP BY ALL
          UNION ALL SELECT 'issuer', source_issuer_id, count(*) FROM once GROUP BY ALL)
    SELECT key_kind, key_name FROM n WHERE key_name IS NOT NULL AND c * 100 >= 4 * (SELECT count(*) FROM once)""",
    "p5_statistics": """
    WITH once AS (SELECT DISTINCT event_id, source_bond_id, CASE WHEN NOT isnan(notional) THEN notional END AS v FROM source_events
                  WHERE event_id IS NOT NULL AND source_bond_id IS NOT NULL),
    freq AS (SELECT source_bond_id, v, count(*) AS f FROM once WHERE v IS NOT NULL GROUP BY ALL),
    modes AS (SELECT source_bond_id, v AS mode FROM freq QUALIFY row_number() OVER (PARTITION BY source_bond_id ORDER BY f DESC, v) = 1),
    stats AS (SELECT source_bond_id, count(*) AS n_rows, round(sum(v), 2) AS total, count(DISTINCT v) AS n_distinct, round(quantile_cont(v, 0.25), 4) AS p25,
              round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75 FROM once GROUP BY ALL)
    SELECT stats.*, mode FROM stats LEFT JOIN modes USING (source_bond_id)""",
    "p7_found": _DAILY + "SELECT source_bond_id, strftime(day, '%Y-%m-%d') AS day FROM sums WHERE before >= 29 AND t30 > 0 AND 4 * t7 >= 3 * t30",
    "p7_totals": _DAILY
    + """SELECT source_bond_id, strftime(day, '%Y-%m-%d') AS day, CAST(n7 AS BIGINT) AS count_7, CAST(n30 AS BIGINT) AS count_30,
         round(t7, 4) AS total_7, round(t7 / 7, 4) AS per_day_7, round(t30, 4) AS total_30, round(t30 / 30, 4) AS per_day_30 FROM sums""",
}
SQL["p5_issuer_statistics"] = SQL["p5_statistics"].replace("source_bond_id", "source_issuer_id")
