"""Queries of the point-in-time state engine, over the whole feed of market events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import engine
from marlstone.operators.engine import DAY, Feature
from marlstone.sources.tables import table

QUERIES, SQL = {}, {}


def _instants(spark: SparkSession, d: str) -> list[dt.datetime]:
    """Four instants spread over the feed, the last one its end."""
    low, high = table(spark, d, "market_events").agg(F.min(F.unix_micros("effective_time")), F.max(F.unix_micros("effective_time"))).first()
    return [dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=low + (high - low) * i // 4) for i in (1, 2, 3, 4)]


_STATE = """
WITH once AS (SELECT DISTINCT ON (event_id, sequence, corrected_event_id, verb) *, coalesce(lower(trim(action)), 'upsert') AS verb, epoch_us(coalesce(effective_time, event_timestamp)) AS us FROM market_events
  WHERE sequence IS NOT NULL AND coalesce(effective_time, event_timestamp) IS NOT NULL),
span AS (SELECT min(epoch_us(effective_time)) AS lo, max(epoch_us(effective_time)) AS hi FROM market_events),
asked AS (SELECT lo + (hi - lo) * i // 4 AS t FROM span, (SELECT unnest([1, 2, 3, 4]) AS i)),
ops AS (SELECT coalesce(corrected_event_id, event_id) AS id, us, sequence, 0 AS kind FROM once WHERE verb = 'cancel'
  UNION ALL SELECT corrected_event_id, us, sequence, 0 FROM once WHERE verb = 'correction'
  UNION ALL SELECT event_id, us, sequence, 1 FROM once WHERE verb != 'cancel'),
last AS (SELECT t, id, sequence, kind FROM asked, ops WHERE id IS NOT NULL AND us <= t QUALIFY row_number() OVER (PARTITION BY t, id ORDER BY us DESC, sequence DESC, kind DESC) = 1),
shown AS (SELECT t, o.us, o.sequence, o.event_id, o.event_type, o.bond_id, o.issuer_id, CASE WHEN side IN (-1, 1) THEN side END AS side, CASE WHEN NOT isnan(notional) THEN notional END AS v
  FROM last JOIN once o ON last.id = o.event_id AND last.sequence = o.sequence AND o.verb != 'cancel' WHERE kind = 1),
keys AS (SELECT DISTINCT t, bond_id AS key FROM shown WHERE bond_id IS NOT NULL)
"""
_OUT = """SELECT k.key, k.t AS as_of_us, '{name}' AS feature_name, CASE WHEN {value} IS NOT NULL THEN round(CAST({value} AS DOUBLE), 4) END AS value, CAST(count(w.us) AS BIGINT) AS observation_count, max(w.us) AS last_us
 FROM keys k LEFT JOIN picked w ON {match} GROUP BY k.key, k.t"""
_BOND = "w.bond_id = k.key AND w.t = k.t"


def query(name: str, feature: Feature, picked: str, value: str, match: str = _BOND):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = engine.snapshot(table(spark, d, "market_events"), [feature], _instants(spark, d))
        return out.select("key", "as_of_us", "feature_name", F.round("value", 4).alias("value"), "observation_count", "last_us")

    run.__name__ = f"engine_{name}"
    run.__doc__ = f"{feature.operator} of {feature.scope} by the {feature.clock} clock, at four instants."
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"{_STATE}, picked AS ({picked}) " + _OUT.format(name=feature.name, value=value, match=match)


def _newest(n: int, types: str, by: str = "bond_id") -> str:
    return f"SELECT * FROM shown WHERE event_type IN ({types}) QUALIFY row_number() OVER (PARTITION BY t, {by} ORDER BY us DESC, sequence DESC, event_id DESC) <= {n}"


#: The five sessions that end with the instant's day begin at a midnight; no holidays.
_SESSIONS = """SELECT * FROM shown WHERE us >= (SELECT min(d) FROM (SELECT epoch_us(CAST(make_timestamp(shown.t) AS DATE) - CAST(i AS INT)) AS d FROM range(14) r(i)
  WHERE isodow(CAST(make_timestamp(shown.t) AS DATE) - CAST(i AS INT)) < 6 ORDER BY d DESC LIMIT 5))"""
_TRADES, _ASKS = "'trace_trade', 'rfq_execution'", "'rfq_inquiry', 'rfq_response', 'firm_up', 'rfq_execution'"

query("calendar_sum", Feature("sum_5d", "sum", size=5 * DAY), _SESSIONS, "sum(w.v)")
query("issuer_mean", Feature("mean_5d", "mean", size=5 * DAY, scope="issuer"), _SESSIONS, "avg(w.v)", "(w.issuer_id = k.key OR w.bond_id = k.key) AND w.t = k.t")
query("trade_clock_median", Feature("median_20", "percentile", clock="trade_event", size=20), _newest(20, _TRADES), "quantile_cont(w.v, 0.5)")
query("request_clock_flow", Feature("flow_10", "signed_count", clock="rfq_event", size=10), _newest(10, _ASKS), "coalesce(sum(w.side), 0)")
query("market_trades_max", Feature("market_max_50", "max", clock="trade_event", size=50, scope="market"), _newest(50, _TRADES, "0"), "max(w.v)", "w.t = k.t")
query(
    "notional_clock_count", Feature("count_5m", "count", clock="notional", size=5e6),
    "SELECT * FROM shown QUALIFY coalesce(sum(abs(coalesce(v, 0))) OVER (PARTITION BY t, bond_id ORDER BY us DESC, sequence DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5e6",
    "count(w.us)",
)
