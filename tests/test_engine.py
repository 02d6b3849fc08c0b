"""The state engine on small feeds: corrections as of an instant, clocks, scopes, flags and business time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.operators import buckets, engine, windows
from marlstone.operators.engine import Feature

FEED = "event_id string, source string, event_type string, event_timestamp timestamp, effective_time timestamp, publication_time timestamp, bond_id string, issuer_id string, side int, notional double, action string, corrected_event_id string, sequence long"
T0 = dt.datetime(2025, 1, 8, 12)  # a Wednesday


def event(name, minutes, size, action=None, target=None, seq=None, bond="b", side=1, kind="trace_trade", published=None):
    at = T0 + dt.timedelta(minutes=minutes)
    return (name, "trace", kind, at, at, None if published is None else T0 + dt.timedelta(minutes=published), bond, "i", side, size, action, target, seq if seq is not None else minutes)


def snap(spark, rows, feature, minutes=(60,), **more):
    out = engine.snapshot(spark.createDataFrame(rows, FEED), [feature], [T0 + dt.timedelta(minutes=m) for m in minutes], **more)
    return {(r.key, (r.as_of_us - int(T0.timestamp() * 1e6)) // 60_000_000 if False else r.as_of_us): r for r in out.collect()}


def values(spark, rows, feature, minutes=(60,), **more):
    return [r.value for r in sorted(snap(spark, rows, feature, minutes, **more).values(), key=lambda r: (r.key, r.as_of_us))]


def test_corrections_as_of_an_instant(spark):
    rows = [event("x", 0, 10.0), event("c", 20, None, "Cancel", "x"), event("x", 40, 7.0, " upsert"), event("y", 50, 5.0, "correction", "x"), event("z", 5, 1.0), event("z", 5, 1.0)]
    assert values(spark, rows, Feature("s", "sum"), (10, 30, 45, 55)) == [11.0, 1.0, 8.0, 6.0]
    # a cancel before its target does nothing
    assert values(spark, [event("q", 0, None, "cancel", "w"), event("w", 1, 3.0)], Feature("s", "sum")) == [3.0]


def test_clocks_and_scopes(spark):
    rows = [event(f"e{i}", i, float(i), bond="ab"[i % 2], side=(-1) ** (i // 2)) for i in range(1, 21)]
    keys = spark.createDataFrame([("a",), ("i",), ("gone",)], "key string")
    assert values(spark, rows, Feature("s", "sum", clock="trade_event", size=3)) == [20 + 18 + 16, 19 + 17 + 15]
    assert values(spark, rows, Feature("s", "sum", clock="trade_event", size=3, scope="issuer"), keys=keys) == [20 + 18 + 16, None, 20 + 19 + 18]
    assert values(spark, rows, Feature("n", "count", clock="notional", size=37.0)) == [2, 3]
    assert values(spark, rows, Feature("m", "max", clock="trade_event", size=2, scope="market")) == [20.0, 20.0]
    assert values(spark, rows, Feature("r", "run_length", clock="trade_event", size=9, scope="market")) == [1.0, 1.0]
    assert values(spark, rows, Feature("d", "mad", clock="trade_event", size=3)) == [2.0, 2.0]
    assert values(spark, rows, Feature("k", "rolling_rank", clock="trade_event", size=3)) == [2.5 / 3, 2.5 / 3]
    with pytest.raises(ValueError):
        values(spark, rows, Feature("i", "intensity", clock="trade_event", size=3))


def test_flags_and_late_publication(spark):
    rows = [event("x", 0, 10.0, published=90), event("y", 10, None, side=None)]
    assert values(spark, rows, Feature("s", "sum"), (60, 100), policy="publication") == [None, 10.0]
    row = next(iter(snap(spark, rows, Feature("s", "sum", event_types=("firm_up",)), stale_after=10.0).values()))
    assert (row.value, row.observation_count, row.quality_flags) == (None, 0, ["no_observations", "missing_value"])
    row = next(iter(snap(spark, rows, Feature("s", "signed_count"), stale_after=10.0).values()))
    assert (row.value, row.effective_sample_size, row.staleness_seconds, row.quality_flags) == (1.0, 2.0, 3000.0, ["missing_side", "stale"])
    bounded = spark.createDataFrame([event("x", 0, 1.0)], FEED).withColumn("active_from", F.lit(T0 + dt.timedelta(minutes=30))).withColumn("active_until", F.lit(None).cast("timestamp"))
    out = engine.snapshot(bounded, [Feature("s", "sum")], [T0 + dt.timedelta(minutes=m) for m in (10, 40)]).orderBy("as_of_us").collect()
    assert [(r.value, "outside_universe" in r.quality_flags) for r in out] == [(None, True), (1.0, False)]
    assert engine.snapshot(bounded.limit(0), [Feature("s", "sum")], [T0]).collect() == []


def test_operators_of_the_newest_event(spark):
    rows = spark.createDataFrame([event("x", 0, 10.0), event("y", 5, 16.0), event("z", 9, 4.0, bond="c"), event("w", 9, None, bond="d")], FEED)
    rows = rows.withColumns({"guess": F.lit(15.0), "mid": F.lit(12.0), "wide": F.when(F.col("bond_id") == "b", 2.0).otherwise(0.0)})
    features = [Feature("r", "residual", predicted="guess"), Feature("z", "time_of_day_zscore", baseline_mean="mid", baseline_std="wide"), Feature("n", "residual")]
    out = {(r.feature_name, r.key): (r.value, r.quality_flags) for r in engine.snapshot(rows, features, [T0 + dt.timedelta(hours=1)]).collect()}
    assert out["r", "b"] == (1.0, []) and out["z", "b"] == (2.0, []) and out["z", "c"] == (None, ["missing_value", "zero_baseline_std"])
    assert out["r", "d"] == (None, ["missing_value", "missing_prediction"]) and out["n", "b"][0] is None


def test_ingestion(spark):
    rows = spark.createDataFrame([event("x", 0, 1.0), event("x", 5, 2.0), event("x", 6, None, "cancel")], FEED)
    assert [r.notional for r in engine.ingested(rows, duplicates="keep_first").orderBy("sequence").collect()] == [1.0, None]
    with pytest.raises(Exception):
        engine.ingested(rows, duplicates="reject").collect()


def test_business_time():
    back, day, holiday = engine.back_in_business, engine.DAY, frozenset({dt.date(2025, 1, 7)})
    assert back(T0, day) == dt.datetime(2025, 1, 8) and back(T0, 2 * day, holiday) == dt.datetime(2025, 1, 6)
    assert back(T0, 5 * day) == dt.datetime(2025, 1, 2)
    monday = dt.datetime(2025, 1, 6, 0, 30)
    assert back(monday, dt.timedelta(hours=2)) == dt.datetime(2025, 1, 3, 22, 30)
    assert back(dt.datetime(2025, 1, 5, 9), dt.timedelta(hours=1)) == dt.datetime(2025, 1, 3, 23) and back(T0, dt.timedelta(0)) == T0


def test_buckets_with_a_hot_key(spark):
    rows = [(("hot" if i % 3 else f"k{i % 7}") if i % 11 else None, (i * 7919) % 400, i, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, us long, id int, v double").withColumn("_chain_key", F.lit("clash"))
    df = df.drop("_chain_key")
    got = {r.id: r for r in buckets.numbered(df, "k", "us", ["id"], {"total": F.col("v")}, width=30).collect()}
    before = {r.id: r.last for r in buckets.known(df, "k", "us", F.when(F.col("id") % 4 == 0, F.col("v")), name="last", width=30).collect()}
    after = {r.id: r.next for r in buckets.known(df, "k", "us", F.when(F.col("id") % 4 == 0, F.col("v")), forward=True, name="next", width=30).collect()}
    for k, us, i, _ in rows:
        own = sorted((u, j, v) for q, u, j, v in rows if q == k)
        earlier = [x for x in own if x[:2] <= (us, i)]
        assert (got[i]["_row"], got[i]["_prior"], got[i].total) == (len(earlier), sum(x[0] < us for x in own), sum(x[2] for x in earlier))
        marks = [(u, v) for u, j, v in own if j % 4 == 0]
        assert before[i] == max((m for m in marks if m[0] < us), default=(0, None))[1]
        assert after[i] == max(((-u, v) for u, v in marks if u > us), default=(0, None))[1]
    runs = windows.run_length(df.withColumn("side", F.when(F.col("id") % 5 < 3, 1).otherwise(-1)).where("k IS NOT NULL"), "k", "us", "side", ["id"])
    for r in runs.collect():
        own = sorted((u, j) for q, u, j, _ in rows if q == r.k and (u, j) <= (r.us, r.id))
        sides = [1 if j % 5 < 3 else -1 for _, j in own]
        n = next((n for n, s in enumerate(reversed(sides)) if s != sides[-1]), len(sides))
        assert r.run_length == n * sides[-1]
