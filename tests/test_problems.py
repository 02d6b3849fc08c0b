"""The general operators against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import asknown, late, replay, rolling, skew
from marlstone.sources.tables import micros

CHANGES = "event_id string, corrected_event_id string, sequence long, action string, a int, b string, _key string"
T0 = dt.datetime(2025, 1, 6)


def feed(seed, n, ids):
    rng = random.Random(seed)
    rows = []
    for s in rng.sample(range(1, 10 * n), n):
        name = lambda: rng.choice([None, *(f"e{i}" for i in range(ids))])
        row = (name(), name() if rng.random() < 0.5 else None, s, rng.choice(["upsert", " UPSERT", None, "cancel", "Cancel ", "correction", "odd"]), rng.choice([None, 1, 2]), rng.choice([None, "x"]), "clash")
        rows += [row] * rng.choice([1, 1, 2])
    rng.shuffle(rows)
    return rows


def replayed(rows, partial):
    state = {}
    for e, c, s, action, a, b, _ in sorted(set(rows), key=lambda r: r[2]):
        verb = (action or "upsert").strip().lower()
        if verb == "cancel":
            state.pop(c if c is not None else e, None)
        if verb == "correction" and c is not None:
            state.pop(c, None)
        if verb in ("upsert", "correction") and e is not None:
            old = state.get(e, (None, None, None)) if partial else (None, None, None)
            state[e] = (s, a if a is not None else old[1], b if b is not None else old[2])
    return {(k, *v) for k, v in state.items()}


@pytest.mark.parametrize("partial", [False, True])
@pytest.mark.parametrize("ids", [40, 3])
def test_replay(spark, partial, ids):
    rows = feed(ids, 400, ids)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        changes = spark.createDataFrame(rows, CHANGES).repartition(5)
        out = replay.replay(changes, columns=["a", "b"], partial=partial)
        assert {tuple(r) for r in out.collect()} == replayed(rows, partial)
        # what is left of two halves of the feed, of interleaved sequences, has the whole's outcome
        halves = [replay.compacted(changes.where(F.col("sequence") % 2 == i), columns=["a", "b"], partial=partial) for i in (0, 1)]
        both = halves[0].unionByName(halves[1])
        assert {tuple(r) for r in replay.replay(both, columns=["a", "b"], partial=partial).collect()} == replayed(rows, partial)
        settled = replay.compacted(both, columns=["a", "b"], partial=partial, settled=max(r[2] for r in rows))
        assert settled.where("action = 'cancel'").count() == 0 and {tuple(r) for r in replay.replay(settled, columns=["a", "b"], partial=partial).collect()} == replayed(rows, partial)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_replay_of_nothing(spark):
    assert replay.replay(spark.createDataFrame([], CHANGES)).collect() == []
    with pytest.raises(ValueError):
        replay.replay(spark.createDataFrame([], CHANGES), columns=["_key"])


TRADE = "trade_id string, bond_id string, source_event_time timestamp, notional double, receive_time timestamp, publication_time timestamp, period int"


def trade(name, arrival, published=None, bond="b", notional=1.0, at=30):
    when = lambda m: None if m is None else T0 + dt.timedelta(minutes=m)
    return (name, bond, when(at), notional, when(arrival), when(published), 0)


def test_late(spark):
    rows = [
        trade("early", 31), trade("edge", 60), trade("kept", 100), trade("limit", 180), trade("gone", 500), trade("never", None), trade("untimed", 70, at=None),
        trade("twice", 500), trade("twice", 90), trade("published", None, 70), trade(None, 70), trade("nan", 61, notional=float("nan")), trade("bondless", 90, bond=None),
    ]
    df = spark.createDataFrame(rows, TRADE)
    got = {tuple(r) for r in late.outcomes(df).collect()}
    assert got == {("edge", "late_kept"), ("kept", "late_kept"), ("limit", "late_dropped"), ("gone", "late_dropped"), ("twice", "late_kept"), ("published", "late_kept"), ("nan", "late_kept"), ("bondless", "late_kept")}
    revisions = {(r.revision, r.n_trades, r.notional) for r in late.triangle(df).collect()}
    assert revisions == {(0, 1, 1.0), (1, 4, 3.0), (3, 6, 5.0)}
    assert late.triangle(df.limit(0)).collect() == [] and late.outcomes(df.limit(0)).collect() == []


def test_as_known(spark):
    rng = random.Random(1)
    pick = lambda: rng.choice([None, *range(0, 60)])
    facts = [(rng.choice(["x", "x", "y", None]), pick(), pick(), pick(), f"f{i}", i) for i in range(150)]
    facts += facts[:20]
    events = [(f"e{i}", rng.choice(["x", "y", "z", None]), pick()) for i in range(60)]
    events += events[:5]
    f = spark.createDataFrame(facts, "k string, e long, p long, r long, id string, v int").withColumn("_us", F.lit(1))
    e = spark.createDataFrame(events, "event string, k string, t long").withColumn("id", F.lit("clash"))
    got = asknown.as_known(e, f, key="k", event_id="event", event_us=F.col("t"), clocks=[F.col("e"), F.col("p"), F.col("r")], attribute_id="id", columns=["v"], bucket_us=10)
    want = set()
    for name, k, t in set(events):
        known = [x for x in facts if None not in x[:4] and x[0] == k and t is not None and max(x[1:4]) <= t]
        if known and k is not None:
            best = max(known, key=lambda x: x[1:5])
            want.add((name, best[4], k, best[5]))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert asknown.as_known(e.limit(0), f.limit(0), key="k", event_id="event", event_us=F.col("t"), clocks=[F.col("e")], attribute_id="id").collect() == []


def test_key_statistics(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice([None, float("nan"), -3.5, 0.0, 2.0, 1e6, rng.random()])) for _ in range(800)]
    got = {r.k: r for r in skew.key_statistics(spark.createDataFrame(rows, "k string, v double").withColumn("freq", F.lit(9)), "k", "v", {"q": 0.3, "m": 0.5}).collect()}
    assert set(got) == {"hot", "cold"}
    for k, r in got.items():
        v = [x for name, x in rows if name == k and x is not None and x == x]
        assert r.n_rows == sum(name == k for name, _ in rows) and r.n_distinct == len(set(v))
        assert r.m == pytest.approx(np.percentile(v, 50)) and r.q == pytest.approx(np.percentile(v, 30)) and r.total == pytest.approx(sum(v))
        assert r.mode == min(set(v), key=lambda x: (-v.count(x), x))
    empty = spark.createDataFrame([], "k string, v double")
    assert skew.key_statistics(empty, "k", "v", {"m": 0.5}).collect() == []


def test_heavy_keys(spark):
    rows = [("a", "i", n) for n in range(96)] + [("b", None, n) for n in range(96, 100)] + [("a", "i", 0), (None, "j", 200), ("c", "i", None)]
    got = {tuple(r) for r in skew.heavy_keys(spark.createDataFrame(rows, "bond string, issuer string, n int"), {"bond": "bond", "issuer": "issuer"}, "n", percent=3).collect()}
    assert got == {("bond", "a", 96), ("bond", "b", 4), ("issuer", "i", 96)}


def test_trailing_totals(spark):
    rng = random.Random(3)
    days = {(k, n): (float(rng.randrange(100)), rng.randrange(1, 4)) for k in ("a", "b") for n in rng.sample(range(80), 15)}
    rows = [(k, T0.date() + dt.timedelta(n), v, c) for (k, n), (v, c) in days.items()] + [(None, T0.date(), 1.0, 1), ("a", None, 1.0, 1)]
    got = rolling.trailing_totals(spark.createDataFrame(rows, "k string, day date, v double, c long"), entity="k", day="day", amount="v", count="c").collect()
    for k in ("a", "b"):
        own = sorted(n for name, n in days if name == k)
        assert sum(r.k == k for r in got) == own[-1] - own[0] + 1
    for r in got:
        n = (r.day - T0.date()).days
        for p in (7, 30):
            inside = [days[r.k, m] for m in range(n - p + 1, n + 1) if (r.k, m) in days]
            assert (r[f"total_{p}"], r[f"count_{p}"]) == (sum(v for v, _ in inside), sum(c for _, c in inside))


def test_micros_of_both_kinds(spark):
    row = spark.createDataFrame([(T0,)], "t timestamp").select(micros("t").alias("a"), micros(F.col("t").cast("timestamp_ntz")).alias("b")).first()
    assert row.a == row.b
