"""Late and out-of-order events: a triangle of event period by arrival period, in SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame

HOUR_US, LATENESS_HOURS, STEP_MINUTES = 3_600_000_000, 2, 15
STEP_US = STEP_MINUTES * 60_000_000
#: The step in which an arrival beyond the cut-off falls, whatever its delay.
BEYOND = LATENESS_HOURS * HOUR_US // STEP_US + 1

#: Distinct trades with their event period and arrival step: step 0 ends with the period, each later one after 15 minutes.
PLACED = f"""
    SELECT trade_id, bond_id, period, amount, CASE WHEN late_us < 0 THEN 0 WHEN late_us >= {LATENESS_HOURS * HOUR_US} THEN {BEYOND} ELSE 1 + CAST(floor(late_us / {STEP_US}D) AS INT) END AS step
    FROM (
      SELECT trade_id, bond_id, period, CASE WHEN isnan(notional) THEN 0D ELSE coalesce(notional, 0D) END AS amount, arrival - (period + 1) * {HOUR_US} AS late_us
      FROM (
        SELECT trade_id, bond_id, notional, CAST(floor(unix_micros(source_event_time) / {HOUR_US}D) AS BIGINT) AS period, min(unix_micros(coalesce(receive_time, publication_time))) AS arrival
        FROM {{trades}} WHERE trade_id IS NOT NULL AND source_event_time IS NOT NULL
        GROUP BY trade_id, bond_id, source_event_time, notional
      ) WHERE arrival IS NOT NULL
    )
"""

#: The triangle's cells with what was known by the end of their step and the last step that counts.
CELLS = f"""
    SELECT bond_id, period, step, sum(n) OVER w AS n_trades, sum(amount) OVER w AS notional,
           max(CASE WHEN step < {BEYOND} THEN step END) OVER (PARTITION BY bond_id, period) AS last_step
    FROM (SELECT bond_id, period, step, count(1) AS n, sum(amount) AS amount FROM ({PLACED}) GROUP BY bond_id, period, step)
    WINDOW w AS (PARTITION BY bond_id, period ORDER BY step ROWS UNBOUNDED PRECEDING)
"""


def outcomes(trades: DataFrame) -> DataFrame:
    """(trade_id, outcome) of trades that arrived at their hour's end or later: 'late_kept' or 'late_dropped'.

    A cell of the triangle corrects its period where it comes after the period's end and enters the last revision; cells
    beyond the cut-off enter none. A trade's outcome is that of its cell, joined on bond, period and step (a null bond is a
    bond of its own). A trade's arrival is the earliest of its copies. Trades without id, arrival or event time give no row.
    """
    return trades.sparkSession.sql(
        f"""
        WITH placed AS ({PLACED}), outcome AS (
          SELECT bond_id, period, step, CASE WHEN step <= last_step THEN 'late_kept' ELSE 'late_dropped' END AS outcome
          FROM (SELECT bond_id, period, step, coalesce(last_step, 0) AS last_step FROM ({CELLS})) WHERE step > 0
        )
        SELECT p.trade_id, o.outcome FROM placed p JOIN outcome o ON p.bond_id <=> o.bond_id AND p.period = o.period AND p.step = o.step
        WHERE p.step > 0
        """,
        trades=trades,
    )


def triangle(trades: DataFrame) -> DataFrame:
    """Every corrected revision per bond and event hour: trades and notional known by the end of each arrival step.

    Revision 0 holds what arrived before the hour's end, revision k what arrived within k further steps of 15 minutes,
    up to two hours. Only steps in which something arrived give a revision. Arrivals beyond the cut-off, and trades
    without bond, arrival or event time, are left out; null or NaN notional adds nothing. Cells are aggregated before
    the windows, so a window partition has ten rows at most, whatever the bond.
    """
    return trades.sparkSession.sql(
        f"""
        SELECT bond_id, date_format(timestamp_micros(period * {HOUR_US}), 'yyyy-MM-dd HH:mm') AS hour, step AS revision, n_trades, round(notional, 4) AS notional
        FROM ({CELLS}) WHERE bond_id IS NOT NULL AND step < {BEYOND}
        """,
        trades=trades,
    )
