"""Statistics of tapes and the alphas' sums on small cases, by hand or by brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import alphas as A
from marlstone.operators import tapestats as T


def test_volume_buckets(spark):
    rows = [("b", 1, 30.0, 1), ("b", 2, 250.0, -1), ("b", 3, None, 1), ("b", 4, 25.0, 1), (None, 1, 500.0, 1)]
    df = spark.createDataFrame(rows, "k string, us long, v double, s int")
    cut = T.volume_buckets(df, "k", "us", "v", "s", [], 100.0)
    assert [(r.bucket, r.buy, r.sell, r.last_us) for r in cut.orderBy("bucket").collect()] == [(0, 30.0, 70.0, 2), (1, 0.0, 100.0, 2), (2, 20.0, 80.0, 4)]
    assert [r.vpin for r in T.vpin(cut, "k", 100.0, 2).orderBy("bucket").collect()] == pytest.approx([0.4, 0.7, 0.8])
    assert T.volume_buckets(df.limit(0), "k", "us", "v", "s", [], 100.0).collect() == []


def test_robust_z_and_ensemble(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert sorted(r.z for r in T.robust_z(df, "v").collect()) == pytest.approx([(v - 3) / 1.4826 for v in values])
    flat = T.robust_z(spark.createDataFrame([(5.0,)] * 3, "v double"), "v")
    assert [r.z for r in flat.collect()] == [0.0] * 3
    row = T.ensemble(df, ["v"]).first()
    assert (row["median"], row["mean"], row["max"]) == (3.0, 22.0, 100.0) and row["std"] == pytest.approx(np.std(values)) and row.p05 == pytest.approx(np.percentile(values, 5))


def test_comovement_and_distance(spark):
    rng = random.Random(2)
    rows = [(g, t, rng.gauss(0, 1)) for g in "abc" for t in range(9) if rng.random() < 0.9] + [("d", 0, 1.0), ("a", 0, None)]
    one = T.comovement(spark.createDataFrame(rows, "g string, t int, v double"), "g", "t", "v").first()
    by = {g: {t: v for q, t, v in rows if q == g and v is not None} for g in "abc"}
    pairs = [np.corrcoef(*zip(*[(by[a][t], by[b][t]) for t in by[a] if t in by[b]]))[0, 1] for a, b in ("ab", "ac", "bc")]
    assert one.pairs == 3 and one.mean_correlation == pytest.approx(np.mean(pairs))
    left, right = (spark.createDataFrame([(x,) for x in xs], "x string") for xs in ("aab", "bc"))
    assert T.l1(left, right, "x").first().l1 == pytest.approx(2 / 3 + 1 / 6 + 0.5)


def test_sessions_and_composite(spark):
    got = [r.session for r in T.sessions(spark, dt.date(2025, 1, 3), 3, [dt.date(2025, 1, 6)]).orderBy("number").collect()]
    assert got == [dt.date(2025, 1, 3), dt.date(2025, 1, 7), dt.date(2025, 1, 8)]
    us = A.micros_of(dt.datetime(2025, 1, 3, 9, 30))
    assert list(spark.range(1).select(T.in_session(F.lit(us)), T.in_session(F.lit(us - 60_000_000)), T.in_session(F.lit(us + 86_400_000_000))).first()) == [dt.date(2025, 1, 3), None, None]
    rows = spark.createDataFrame([("d", "a", "x", 1.0), ("d", "a", "y", -2.0), ("d", "b", "x", None), ("d", "c", "y", 3.0)], "day string, asset string, family string, score double")
    out = T.composite(rows, ["day", "asset"], "family", "score", {"y": 2.0}, top=2).collect()
    assert [(r.asset, r.score, r.direction, r.component_count) for r in out] == [("c", 3.0, "long", 1), ("a", -1.0, "short", 2)]


def test_forward(spark):
    df = spark.createDataFrame([("k", 0, "a", 1.0), ("k", 10, "b", 2.0), ("k", 10, "c", 3.0), ("k", 25, "d", 4.0)], "k string, us long, id string, v double")
    assert {r.id: r.v_2 for r in T.forward(df, "k", "us", ["id"], ["v"], [2]).collect()} == {"a": 3.0, "b": 4.0, "c": None, "d": None}
    assert {r.id: r.future for r in T.first_at_or_after(df, "k", "us", "v", 10, ["id"]).collect()} == {"a": 2.0, "b": 4.0, "c": 4.0, "d": None}


def test_alpha_sums_with_a_hot_key(spark):
    rng = random.Random(3)
    stream = [(rng.choice(["h", "h", "h", "k", None]), rng.choice([None, *range(60)]), i, rng.choice([-1, 0, 1, None]), rng.choice([None, 1.0, 5.0])) for i in range(150)]
    grid = [(rng.choice(["h", "k", "none"]), rng.randrange(70), i) for i in range(40)]
    s, g = spark.createDataFrame(stream, "k string, us long, id int, side int, v double"), spark.createDataFrame(grid, "k string, us long, gid int")
    sums = A.side_sums("side", F.col("v"))
    calendar = {r.gid: r for r in A.calendar_sums(g, s, "k", "us", "gid", sums, {"w": 20}).collect()}
    events = {r.gid: r for r in A.event_sums(g, s, "k", "us", "gid", sums, ["id"], [4]).collect()}
    keep = A.persistence(g, s, "k", "us", "gid", "side", ["id"], [4])
    lasts = {r.gid: r for r in keep.collect()}
    for k, us, i in grid:
        own = sorted((u, j, d, v) for q, u, j, d, v in stream if q == k and u is not None and u < us)
        inside = [x for x in own if x[0] >= us - 20]
        assert calendar[i].n_w == len(inside) and (calendar[i].buy_w or 0) == sum(x[3] or 0 for x in inside if x[2] == 1)
        last = own[-4:]
        assert events[i].n_last_4 == len(last) and (events[i].sell_last_4 or 0) == sum(x[3] or 0 for x in last if x[2] == -1)
        sided = [x for x in own if x[2] in (-1, 1)]
        r = lasts[i]
        if not sided:
            assert r.last_side is None and r.fraction_same_last_4 is None
            continue
        sides = [x[2] for x in sided]
        run = next((n for n, x in enumerate(reversed(sides)) if x != sides[-1]), len(sides))
        other = [x[0] for x in sided if x[2] != sides[-1]]
        assert (r.last_side, r.same_side_run_length) == (sides[-1], run) and r.elapsed_seconds_since_side_change == (None if not other else (us - other[-1]) / 1e6)
        tail = sides[-4:]
        assert r.fraction_same_last_4 == pytest.approx(np.mean([x == sides[-1] for x in tail]))
        switches = sum(a != b for a, b in zip(tail, tail[1:]))
        assert r.switching_hazard_last_4 == (None if len(tail) < 2 else pytest.approx(switches / (len(tail) - 1), abs=1e-6))


def test_baseline_and_surprise(spark):
    train = spark.createDataFrame([("a", "x", float(v)) for v in (1, 2, 3, 4)] + [("b", "x", 10.0), ("c", "y", 7.0)], "bond string, issuer string, v double")
    levels = (("bond",), ("issuer",))
    base = A.baseline(train, "v", levels, 2)
    assert {(r.level, r.bond or r.issuer, r.n) for r in base.collect()} == {(0, "a", 4), (1, "x", 5)}
    out = {r.bond: r for r in A.surprise(spark.createDataFrame([("a", "x", 5.0), ("b", "x", 5.0), ("z", None, 5.0)], "bond string, issuer string, v double"), "v", base, levels).collect()}
    low = np.percentile([1, 2, 3, 4, 10, 7], 1)
    mine = [low, 2, 3, 4]
    assert out["a"].surprise == pytest.approx((5 - np.mean(mine)) / np.std(mine, ddof=1)) and out["b"].expected < 5 and out["z"].surprise is None
    weights = {r.measure: r for r in A.side_weights(spark.createDataFrame([(1, 1, 2.0), (2, 1, 4.0), (3, -1, 3.0), (9, -1, 100.0)], "us long, side int, v double"), "us", "side", {"count": F.lit(1.0), "v": F.col("v")}, 5).collect()}
    assert (weights["count"].buy_weight, weights["count"].sell_weight, weights["v"].sell_weight) == (0.75, 1.5, 1.5)
