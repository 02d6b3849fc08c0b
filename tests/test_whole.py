"""Results that need a key's whole history, against brute force, through the registered queries."""

import datetime as dt
import random
import re

import pytest

import __spark_entry__ as entry

T0 = dt.datetime(2021, 1, 4)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark, folder, rows):
    """``rows``: (seconds, bond, kind, value)."""
    spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), b, k, v, None) for i, (s, b, k, v) in enumerate(rows)], EVENTS).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_a3_intensity(spark, tmp_path):
    rng, day = random.Random(7), 86_400
    rows = [(rng.randrange(90 * day), rng.choice([1, 2]), rng.choice(["purchase", "signup", "click", "error", "view"]), 1.0) for _ in range(150)]
    rows += [(50 * day, 3, "purchase", 1.0), (50 * day, 3, "purchase", 1.0), (75 * day, 3, "view", 1.0), (90 * day, 3, "click", 1.0), (90 * day, 3, "click", 1.0), (1050 * day, 3, "view", 1.0), (2200 * day, 3, "view", 1.0)]
    got = {r.id: r for r in entry.queries()["a3_intensity"](spark, events(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    for i, (s, b, _, _) in enumerate(rows):
        for name, kinds in (("buy_intensity", ("purchase", "signup")), ("sell_intensity", ("click", "error"))):
            ages = [s - t for t, c, k, _ in rows if c == b and k in kinds and t < s]
            want = sum(2.0 ** (-a / day) for a in ages) / day if ages else None
            # past 2^-1022 a double has fewer digits
            assert got[i][name] == (want if want is None else pytest.approx(want, rel=1e-8 if want > 1e-300 else 1e-2, abs=1e-322)), (i, name)


def test_clock_notional(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(5000), 1, "view", rng.choice([None, 0.0, 0.1, 1.25, 7.0, -3.3])) for _ in range(400)]
    rows += [(n, 2, "view", 10.0) for n in range(60)] + [(70, 2, "view", 300.0), (71, 2, "view", None)]
    got = {r.id: r.events_needed for r in entry.queries()["clock_notional"](spark, events(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    for i, (s, b, _, _) in enumerate(rows):
        back, total, want = sorted(((t, j) for j, (t, c, _, _) in enumerate(rows) if c == b and (t, j) <= (s, i)), reverse=True), 0, None
        for n, (_, j) in enumerate(back, 1):
            total += round(abs(rows[j][3] or 0.0) * 100)
            if total >= 30_000:
                want = n
                break
        assert got[i] == want
    assert max(v for v in got.values() if v) > 20


def test_p5_issuer_statistics(spark, tmp_path):
    rows = [(1, "b", "i", 5.0), (1, "b", "i", 5.0), (2, "c", "i", 5.0), (3, "c", "i", 2.0), (4, None, "j", None), (5, "b", None, 9.0), (None, "b", "i", 1.0)]
    spark.createDataFrame(rows, "event_id long, source_bond_id string, source_issuer_id string, notional double").write.parquet(f"{tmp_path}/source_events.parquet")
    got = {r.source_issuer_id: r for r in entry.queries()["p5_issuer_statistics"](spark, str(tmp_path)).collect()}
    assert set(got) == {"i", "j"}
    assert (got["i"].n_rows, got["i"].total, got["i"].n_distinct, got["i"].mode, got["i"].p50) == (3, 12.0, 2, 5.0, 5.0)
    assert (got["j"].n_rows, got["j"].total, got["j"].n_distinct, got["j"].mode, got["j"].p50) == (1, None, 0, None, None)


def test_issuer_crowding(spark, tmp_path):
    rng, day, hour = random.Random(9), 86_400, 3600
    late = lambda: rng.choice([0, 0, -50 * 365 * day]) + rng.randrange(100) * hour  # noqa: E731, steps of an hour meet at either edge; some before 1970
    rows = [(i, late(), rng.randrange(25), rng.choice(["purchase", "signup", "click", "error", "view", None])) for i in range(400)]
    rows += [(7, late(), 3, "click"), (7, 5 * hour, 4, "purchase"), (None, 30 * hour, 4, "view"), (None, 31 * hour, 5, "view")]  # ids again, and none
    rows += [(500 + i, rng.choice([None, 40 * hour]), None, "click") for i in range(20)] + [(600 + i, None, i % 3, "signup") for i in range(20)]
    stamps = [(i, None if s is None else T0 + dt.timedelta(seconds=s), b, k, 1.0, None) for i, s, b, k in rows]
    spark.createDataFrame(stamps, EVENTS).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    df = entry.queries()["issuer_crowding"](spark, str(tmp_path))
    got = {r.id: (r.crowding, r.disagreement) for r in df.collect()}
    sides, want = {"purchase": 1, "signup": 1, "click": -1, "error": -1}, {}
    for i, s, b, _ in rows:
        want.setdefault(i, []).extend(sides.get(k, 0) for _, t, c, k in rows if None not in (s, t, b, c) and c % 10 == b % 10 and s - day <= t < s)
    assert df.count() == len(want) and max(map(len, want.values())) > 5
    for i, seen in want.items():
        sided = sum(map(abs, seen))
        assert got[i] == (pytest.approx(1 / (1 + len(seen)), abs=1e-6), pytest.approx(1 - abs(sum(seen)) / sided, abs=1e-6) if sided else None), i


def test_issuer_crowding_adds_up_no_window_anew(spark, tmp_path):
    df = entry.queries()["issuer_crowding"](spark, events(spark, tmp_path, [(0, 1, "view", 1.0)]))
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+),", df._jdf.queryExecution().optimizedPlan().toString())
    assert frames and all(start == "unboundedpreceding$()" for _, start in frames), frames
