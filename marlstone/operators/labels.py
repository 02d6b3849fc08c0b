"""Labels of prediction events: what the fair value and the next events turned out to be, horizon by horizon."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import asknown, buckets
from marlstone.sources.tables import micros

#: Horizons by their spellings: minutes, or business days; fixed values.
HORIZONS = {"30m": ("minutes", 30), "2h": ("minutes", 120), "1bd": ("days", 1), "5bd": ("days", 5)}
DECISIONS = ("responded", "firmed_up", "won", "executed", "response_latency_ms", "quoted_spread", "quoted_price", "realized_edge")
MINUTE = 60_000_000


def add_business_days(us: Column, n: int, holidays: Sequence[dt.date] = ()) -> Column:
    """``n`` business days after an instant, its time of day kept: the n-th later day that is neither weekend nor holiday."""
    if n == 0:
        return us
    day = F.to_date(F.timestamp_micros(us))
    ahead = F.sequence(F.date_add(day, 1), F.date_add(day, n * 7 // 5 + 4 + len(holidays) * 3))
    closed = F.array(*[F.lit(h) for h in holidays]).cast("array<date>")
    open_ = F.filter(ahead, lambda x: (F.weekday(x) < 5) & ~F.coalesce(F.array_contains(closed, x), F.lit(False)))
    return us + F.datediff(F.get(open_, F.lit(n - 1)), day).cast("long") * buckets.DAY


def horizon_end(us: Column, horizon: str, holidays: Sequence[dt.date] = ()) -> Column:
    kind, n = HORIZONS[horizon]
    return us + n * MINUTE if kind == "minutes" else add_business_days(us, n, holidays)


def targets(
    events: DataFrame, values: DataFrame, horizons: Sequence[str] = tuple(HORIZONS), *, holidays: Sequence[dt.date] = (), stale_days: int = 2, hurdle: float = 0.0, cost: float = 0.0
) -> DataFrame:
    """One row per event: per horizon the price target, whether it is censored, the OAS price equivalent, signed move,
    aggressive flag, dealer's markout and toxic flag.

    Now and all horizons are looked up in one pass: every event asks at its own time and at each horizon's end for the value
    that was effective, published and revised by then. A target is censored where either value is missing or the later one
    is older than ``stale_days``. Repeated event rows count once; events without id, bond or time give no row.
    """
    kept = [c for c in ("customer_side", "executed_notional", "execution_price") if c in events.columns]
    rows = events.select("event_id", "bond_id", micros("prediction_timestamp").alias("_us"), *kept).where("event_id IS NOT NULL AND bond_id IS NOT NULL AND _us IS NOT NULL").dropDuplicates(["event_id"])
    asks = [F.struct(F.lit("now").alias("h"), F.col("_us").alias("t"))] + [F.struct(F.lit(h).alias("h"), horizon_end(F.col("_us"), h, holidays).alias("t")) for h in horizons]
    asked = rows.select("bond_id", "event_id", F.inline(F.array(*asks))).withColumn("ask", F.struct("event_id", "h"))
    published = F.coalesce("publication_time", "effective_time")
    effective = micros("effective_time")
    facts = values.where("fair_value IS NOT NULL AND NOT isnan(fair_value)").withColumn("_effective", effective)
    found = asknown.as_known(
        asked, facts, key="bond_id", event_id="ask", event_us=F.col("t"), clocks=[effective, micros(published), micros(F.coalesce("revision_time", published))], attribute_id="fair_value_id",
        columns=("fair_value", "oas", "duration", "_effective"),
    )
    value = F.struct("fair_value", "oas", "duration", "_effective")
    wide = found.groupBy(F.col("ask.event_id").alias("event_id")).agg(*[F.max(F.when(F.col("ask.h") == h, value)).alias(f"_{h}") for h in ("now", *horizons)])
    out = rows.join(wide, "event_id", "left")
    side = F.when(F.col("customer_side").isin(-1, 1), F.col("customer_side")) if "customer_side" in kept else F.lit(None).cast("int")
    now, columns = F.col("_now"), {}
    for h in horizons:
        later = F.col(f"_{h}")
        known = F.coalesce(now["fair_value"].isNotNull() & later["fair_value"].isNotNull() & (horizon_end(F.col("_us"), h, holidays) - later["_effective"] <= stale_days * buckets.DAY), F.lit(False))
        target = F.when(known, later["fair_value"] - now["fair_value"])
        columns[f"price_target_{h}"], columns[f"label_censored_{h}"] = target, ~known
        columns[f"oas_price_equivalent_{h}"] = F.when(known, -now["duration"] * (later["oas"] - now["oas"]))
        columns[f"signed_move_{h}"] = side * target
        columns[f"aggressive_{h}"] = (side * target > hurdle).cast("int")
        if len(kept) == 3:
            # the dealer's inventory moves against the customer; where the customer's side is 0 so is the markout
            markout = F.signum(-F.col("customer_side") * F.coalesce("executed_notional", F.lit(0.0))) * (later["fair_value"] - F.col("execution_price"))
            columns[f"dealer_markout_{h}"], columns[f"dealer_toxic_{h}"] = markout, (markout < -cost).cast("int")
    return out.select("event_id", "bond_id", *[c.alias(n) for n, c in columns.items()])


def next_event(events: DataFrame, stream: DataFrame, prefix: str) -> DataFrame:
    """(event_id, next_<prefix>_side, time_to_next_<prefix>_seconds): the first event of ``stream`` on the bond strictly later;
    of several at one instant that of the smallest event_id. Repeated rows count once."""
    ask = events.select("event_id", "bond_id", micros("prediction_timestamp").alias("_us"), F.lit(None).cast("string").alias("_n"), F.lit(None).cast("int").alias("_s"))
    come = stream.select(F.lit(None).cast("string").alias("event_id"), "bond_id", micros("prediction_timestamp").alias("_us"), F.col("event_id").alias("_n"), F.col("customer_side").alias("_s"))
    both = ask.where("event_id IS NOT NULL").unionByName(come.where("_n IS NOT NULL")).where("bond_id IS NOT NULL AND _us IS NOT NULL").distinct()
    # of one instant only the event of the smallest id may be found
    first = come.where("_n IS NOT NULL AND bond_id IS NOT NULL AND _us IS NOT NULL").groupBy("bond_id", "_us").agg(F.min(F.struct("_n", "_s")).alias("_first"))
    merged = both.where("event_id IS NOT NULL").select("event_id", "bond_id", "_us").withColumn("_mark", F.lit(None).cast("struct<t:bigint,s:int>")).unionByName(
        first.select(F.lit(None).cast("string").alias("event_id"), "bond_id", "_us", F.struct(F.col("_us").alias("t"), F.col("_first._s").alias("s")).alias("_mark"))
    )
    found = buckets.known(merged, "bond_id", "_us", F.col("_mark"), forward=True, name="_next").where("event_id IS NOT NULL")
    return found.select("event_id", F.col("_next.s").alias(f"next_{prefix}_side"), ((F.col("_next.t") - F.col("_us")) / 1e6).alias(f"time_to_next_{prefix}_seconds"))


def label_frame(events: DataFrame, values: DataFrame, stream: DataFrame | None = None, **settings) -> DataFrame:
    """Targets, next request, executed request and side-valid trade, and the decision columns, one row per event."""
    stream = events if stream is None else stream
    base = events.where("event_id IS NOT NULL AND bond_id IS NOT NULL AND prediction_timestamp IS NOT NULL").dropDuplicates(["event_id"])
    executed, valid = F.coalesce("executed", F.lit(False)), F.coalesce("side_valid", F.lit(False))
    parts = [
        targets(base, values, **settings), next_event(base, stream.where("source = 'rfq'"), "rfq"), next_event(base, stream.where((F.col("source") == "rfq") & executed), "executed_rfq"),
        next_event(base, stream.where((F.col("source") == "trace") & valid), "trace"), base.select("event_id", *[c for c in DECISIONS if c in base.columns]),
    ]
    return reduce(lambda a, b: a.join(b, "event_id", "left"), parts)


def coverage(labels: DataFrame, attributes: DataFrame, horizons: Sequence[str], groups: Sequence[str] = ("bond_id", "issuer_id", "rating", "liquidity_bucket")) -> DataFrame:
    """Per group (nulls are groups) and horizon: rows, labelled rows and their share."""
    joined = labels.join(attributes, "bond_id", "left")
    long = joined.select(*groups, F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"price_target_{h}").isNotNull().cast("int").alias("_known")) for h in horizons])))
    return long.groupBy(*groups, "horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("_known").cast("long").alias("labelled"), F.avg("_known").alias("coverage"))
