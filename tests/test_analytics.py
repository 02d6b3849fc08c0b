"""Labels, portfolios, profit and loss, evaluation and triplets on small cases worked out by hand or by brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import evaluation, labels, pnl, portfolio, triplets

T0 = dt.datetime(2025, 1, 10, 15)  # a Friday
INF = float("inf")


def test_long_short_and_positions(spark):
    rows = [("t", b, s, r) for b, s, r in (("a", 3.0, 2.0), ("b", 1.0, 4.0), ("c", 2.0, 0.0), ("d", None, 1.0), ("e", INF, 1.0), ("f", 9.0, 1.0))] + [("u", "a", None, 1.0), ("v", "a", 5.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, bond string, signal double, cr01 double")
    got = {(r.g, r.bond): r for r in portfolio.target_positions(df, signal="signal", instrument="bond", groups=["g"], risk="cr01").collect()}
    # four finite signals: b and c short, a and f long, each a quarter of gross; c has no risk unit
    assert [got["t", b].target_position for b in "abcdef"] == [0.125, -0.0625, 0.0, 0.0, 0.0, 0.25]
    assert got["t", "a"].realized_gross_exposure == 0.75 and got["t", "a"].target_weight == pytest.approx(1 / 3) and got["t", "a"].portfolio_quality_flag == "partial_invalid_risk_unit"
    assert got["u", "a"].portfolio_quality_flag == "flat_no_valid_signals" and got["v", "a"].portfolio_quality_flag == "flat_after_scaling"
    capped = {r.bond: r for r in portfolio.target_positions(df.where("g = 't'"), signal="signal", instrument="bond", groups=["g"], method="signal_proportional", cap=0.1).collect()}
    assert capped["f"].target_position == 0.1 and capped["b"].target_position == pytest.approx(1 / 15)


def test_weights(spark):
    df = spark.createDataFrame([("t", b, s, v) for b, s, v in (("a", 2.0, 1.0), ("b", -4.0, 2.0), ("c", None, 1.0), ("d", 2.0, 0.0))], "g string, bond string, s double, v double")
    one = lambda c: [r[0] for r in df.select(c.alias("x"), "bond").orderBy("bond").select("x").collect()]
    assert one(portfolio.inverse_volatility(F.col("s"), F.col("v"), ["g"])) == pytest.approx([2 / 3, -1 / 3, 0, 0])
    assert one(portfolio.proportional(F.col("s"), ["g"])) == [0.25, -0.5, 0.0, 0.25]
    assert one(portfolio.proportional(F.col("s"), ["g"], volatility=F.col("v"), power=1.0)) == [0.5, -0.5, 0.0, 0.0]
    assert one(portfolio.rank_halves(F.col("s"), ["g"], ["bond"])) == [0.0, -0.5, 0.0, 0.5]
    assert one(portfolio.rank_halves(F.col("s"), ["g"], ["bond"], mask=F.col("bond") == "a")) == [None] * 4
    linear = portfolio.linear_halves(df, "s", ["g"]).orderBy("bond").select("weight").collect()
    assert [r[0] for r in linear] == [0.25, -0.5, 0.0, 0.25]
    neutral = portfolio.beta_neutral(df.withColumn("w", F.coalesce("s", F.lit(0.0))), "w", "v", ["g"]).collect()
    assert sum(r.neutral_weight * r.v for r in neutral) == pytest.approx(0)
    bound = {r.bond: r.bounded_weight for r in portfolio.bounded(df, "s", ["g"], lower=-0.4, upper=0.4, gross=1.0).collect()}
    current = np.clip([2.0, -4.0, 0.0, 2.0], -0.4, 0.4)
    for _ in range(20):
        current = np.clip(current / abs(current).sum(), -0.4, 0.4)
    assert [bound[b] for b in "abcd"] == pytest.approx(list(current))
    steps = spark.createDataFrame([("a", t, s) for t, s in enumerate([0.2, 1.2, 0.7, 0.4, -1.5, -0.6, None])], "bond string, t int, s double")
    assert [r.position for r in portfolio.hysteresis(steps, "s", "bond", "t", enter=1.0, exit=0.5).orderBy("t").collect()] == [0, 1, 1, 0, -1, -1, 0]
    w = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.5), ("b", 2, -1.0), ("b", 3, None)], "bond string, t int, w double")
    assert {(r.bond, r.t): r.tranche_weight for r in portfolio.tranches(w, "w", "bond", "t", 2).collect()} == {("a", 1): 0.5, ("a", 2): 0.75, ("a", 3): 0.25, ("b", 2): -0.5, ("b", 3): -0.5}
    fit = portfolio.residualised(spark.createDataFrame([("a", float(x), 2.0 * x + 1) for x in range(4)], "bond string, x double, y double"), "y", "x", "bond").collect()
    assert all(r.residual == pytest.approx(0) for r in fit)


def test_pnl(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([-1.0, 3.0, None, 0.0, -2.0])] + [("b", 0, 1.0), ("c", 0, None)], "k string, t int, x double")
    curve = pnl.curve(df.where("k = 'a' AND x IS NOT NULL"), "x", ["t"], ["k"]).orderBy("t").collect()
    # a loss on the first day is no drawdown: the curve has no higher point before it
    assert [(r.equity, r.drawdown, r.runup) for r in curve] == [(-1, 0, 0), (2, 0, 3), (2, 0, 3), (0, -2, 1)]
    got = {r.k: r for r in pnl.summary(df, "x", ["t"], ["k"], annualization=4).collect()}
    a, b = got["a"], got["b"]
    assert (a["count"], a.total_pnl, a.profit_factor, a.win_rate, a.max_drawdown, a.max_runup) == (4, 0.0, 1.0, pytest.approx(1 / 3), -2, 3)
    assert a.volatility == pytest.approx(2 * np.std([-1, 3, 0, -2], ddof=1)) and a.sharpe_like_ratio == 0
    assert (b.volatility, b.sharpe_like_ratio, b.profit_factor, b.win_rate) == (None, None, INF, 1.0) and "c" not in got
    row = df.limit(1).select(pnl.price_pnl(F.lit(2.0), F.lit(10.0), F.lit(11.0), 0.5), pnl.spread_pnl(F.lit(2.0), F.lit(3.0), F.lit(1.0), F.lit(2.0)), pnl.marked_pnl(F.lit(5.0), F.lit(2.0), F.lit(3.0), 1.0), pnl.gross_exposure(F.lit(-2.0), F.lit(3.0))).first()
    assert tuple(row) == (1.5, -6.0, 10.0, 6.0)


def test_binary_metrics(spark):
    rng = random.Random(4)
    data = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(300)] + [(1.0, 1), (1.0, 0), (0.0, 0)]
    df = spark.createDataFrame(data, "p double, y int").union(spark.createDataFrame([(None, 1)], "p double, y int"))
    m = evaluation.binary_metrics(df, "p", "y").first()
    p, y = np.clip(np.array([x for x, _ in data]), 1e-12, 1 - 1e-12), np.array([x for _, x in data])
    wins = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    area, seen, hit = 0.0, 0, 0
    for s in sorted(set(p), reverse=True):
        seen, hit = seen + (p == s).sum(), hit + y[p == s].sum()
        area += y[p == s].sum() * hit / seen
    width = np.minimum((p * 10).astype(int), 9)
    ece = sum(abs(y[width == b].mean() - p[width == b].mean()) * (width == b).mean() for b in set(width))
    assert m.log_loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))) and m.brier == pytest.approx(np.mean((p - y) ** 2))
    assert m.roc_auc == pytest.approx(np.mean(wins)) and m.pr_auc == pytest.approx(area / y.sum()) and m.ece == pytest.approx(ece)
    assert (m.tp, m.fn, m.fp, m.tn) == tuple(((p >= 0.5) == a)[y == b].sum() for a, b in ((True, 1), (False, 1), (True, 0), (False, 0)))
    one = evaluation.binary_metrics(df.where("y = 1"), "p", "y").first()
    assert one.roc_auc is None and one.pr_auc is None
    assert evaluation.binary_metrics(df.limit(0), "p", "y").first().log_loss is None
    line = evaluation.calibration_line(df.where("p > 0 AND p < 1"), "p", "y")
    x, yy = np.array([math.log(a / (1 - a)) for a, _ in data if 0 < a < 1]), np.array([b for a, b in data if 0 < a < 1])
    q = 1 / (1 + np.exp(-(line[0] + line[1] * x)))
    assert abs((yy - q).sum()) < 1e-4 and abs(((yy - q) * x).sum()) < 1e-3
    sizes = [r.row_count for r in evaluation.deciles(spark.createDataFrame([(i / 10, 0) for i in range(7)], "p double, y int"), "p", "y", [], n=3).orderBy("bucket").collect()]
    assert sizes == [3, 2, 2]  # right-closed edges at ranks 3 and 5


def test_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = x @ [1.5, -2.0] + 0.3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    w = evaluation.ridge(df, ["a", "b"], "y", alpha=2.0)
    centred = x - x.mean(0)
    assert [w["a"], w["b"]] == pytest.approx(list(np.linalg.solve(centred.T @ centred + 2 * np.eye(2), centred.T @ (y - y.mean()))))
    assert df.limit(3).select(evaluation.linear_score(w)).first()[0] == pytest.approx(w["intercept"] + w["a"] * x[0, 0] + w["b"] * x[0, 1])
    rates = evaluation.conditional_rate(spark.createDataFrame([("u", 1), ("u", 0), ("v", 1)], "k string, y int"), spark.createDataFrame([("u",), ("w",)], "k string"), "k", "y")
    assert {r.k: r.probability for r in rates.collect()} == {"u": 0.5, "w": pytest.approx(2 / 3)}
    model = evaluation.logistic(df.withColumn("won", (F.col("y") > 0).cast("double")), ["a", "b"], "won")
    assert evaluation.predicted(model, df).where((F.col("probability") > 0.5) == (F.col("y") > 0)).count() > 190
    with pytest.raises(ValueError):
        evaluation.guard(spark.createDataFrame([(1, 2)], "at int, seen int"), "at", ["seen"])
    assert spark.createDataFrame([(1.0, None), (float("nan"), None)], "a double, b double").select(evaluation.blend("a", "b")).collect() == [(1.0,), (None,)]
    # the p-value of a correlation of 0.5 among 20 rows
    assert evaluation.t_survival(0.5 * math.sqrt(18 / 0.75), 18) == pytest.approx(0.0247666, abs=1e-5) and evaluation.t_survival(0.0, 5) == pytest.approx(1)


def test_labels(spark):
    at = lambda **k: T0 + dt.timedelta(**k)
    values = spark.createDataFrame(
        [("v1", "b", at(hours=-1), None, None, 100.0, 50.0, 4.0), ("v2", "b", at(minutes=20), None, None, 101.0, 49.0, 4.0), ("late", "b", at(minutes=25), at(minutes=40), None, 150.0, 1.0, 4.0), ("v3", "b", at(days=3, hours=-2), None, None, 99.0, None, 4.0)],
        "fair_value_id string, bond_id string, effective_time timestamp, publication_time timestamp, revision_time timestamp, fair_value double, oas double, duration double",
    )
    events = spark.createDataFrame(
        [("e", "b", "rfq", T0, -1, True, None, 10.0, 99.5), ("e", "b", "rfq", T0, -1, True, None, 10.0, 99.5), ("f", "b", "trace", at(minutes=5), 1, None, True, None, None), ("g", "x", "rfq", T0, 1, False, None, None, None), ("h", None, "rfq", T0, 1, None, None, None, None)],
        "event_id string, bond_id string, source string, prediction_timestamp timestamp, customer_side int, executed boolean, side_valid boolean, executed_notional double, execution_price double",
    )
    out = {r.event_id: r for r in labels.label_frame(events, values).collect()}
    assert set(out) == {"e", "f", "g"}
    e = out["e"]
    assert (e.price_target_30m, e.oas_price_equivalent_30m, e.signed_move_30m, e.aggressive_30m, e.label_censored_30m) == (1.0, 4.0, -1.0, 0, False)
    assert (e.dealer_markout_30m, e.dealer_toxic_30m) == (1.5, 0)  # the customer sold, so the dealer is long from 99.5
    assert e.price_target_2h == 50.0  # published by then
    assert e.price_target_1bd == -1.0 and e.oas_price_equivalent_1bd is None  # Monday at the same time
    assert e.label_censored_5bd and e.price_target_5bd is None and e.dealer_markout_5bd == -0.5  # older than two days
    assert (e.next_trace_side, e.time_to_next_trace_seconds, e.next_rfq_side) == (1, 300.0, None)
    assert out["g"].price_target_30m is None and out["g"].label_censored_30m and out["f"].next_trace_side is None
    micro = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    ends = spark.range(1).select(*[labels.add_business_days(F.lit(micro(T0)), n, h) for n, h in ((1, ()), (5, ()), (1, (dt.date(2025, 1, 13),)), (0, ()))]).first()
    assert list(ends) == [micro(at(days=d)) for d in (3, 7, 4, 0)]
    cover = labels.coverage(labels.targets(events, values), spark.createDataFrame([("b", "i", "AA", None)], "bond_id string, issuer_id string, rating string, liquidity_bucket string"), ["30m"]).collect()
    assert {(r.bond_id, r.rating, r.n, r.labelled) for r in cover} == {("b", "AA", 2, 2), ("x", None, 1, 0)}
    assert labels.targets(events.limit(0), values.limit(0)).collect() == []


def test_triplets(spark):
    tape = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([3, 4, 5, 1, 9, 0, 2])] + [("b", 3, 20.0), (None, 1, 9.0)], "k string, us long, v double")
    ticks = [(r.k, r.clock_index, r.us) for r in triplets.information_clock(tape, "k", "us", "v", 7.0, []).orderBy("k", "us").collect()]
    assert ticks == [("a", 0, 1), ("a", 1, 4), ("b", 0, 3)]  # what goes beyond 7 is lost, so 5 + 1 does not tick
    with pytest.raises(Exception):
        triplets.information_clock(tape.withColumn("v", -F.col("v")), "k", "us", "v", 7.0, []).collect()
    clock = triplets.calendar_clock(spark, "1970-01-01 00:00:00", "1970-01-01 00:00:02", "INTERVAL 1 SECOND")
    state = spark.createDataFrame([("a", 0, 1.0), ("a", 1_500_000, 4.0), ("a", 1_600_000, None), ("b", 1_000_000, 7.0)], "k string, us long, v double")
    assert [(r.k, r.clock_index, r.v) for r in triplets.sampled(state, clock, "k", "us", "v").orderBy("k", "clock_index").collect()] == [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 4.0), ("b", 1, 7.0), ("b", 2, 7.0)]
    rng = random.Random(1)
    walk = [("a", i, i, round(rng.gauss(0, 1), 1), 2.0) for i in range(60)]
    df = spark.createDataFrame(walk, "k string, clock_index int, us int, v double, duration double")
    rows = triplets.panel(df, "k", "us", "v", lags=[1], horizons=[1, 2])
    v = [r[3] for r in walk]
    got = {(r.horizon, r.clock_index): (r.past_move, r.future_move) for r in rows.collect()}
    assert got == {(h, i): (v[i] - v[i - 1], v[i + h] - v[i]) for h in (1, 2) for i in range(1, 60 - h)}
    spread = triplets.panel(df, "k", "us", "v", lags=[1], horizons=[1], duration="duration").where("clock_index = 1").first()
    assert spread.past_move == pytest.approx(-2 * (v[1] - v[0])) and spread.target_type == "spread_implied"
    registry = spark.createDataFrame([(1, 0, 1, "clean_price"), (1, 0, 2, "clean_price"), (9, 0, 1, "clean_price")], "lag int, anchor int, horizon int, target_type string")
    estimates = triplets.estimates(rows, registry)
    found = {(r.lag, r.horizon): r for r in estimates.collect()}

    def ranks(x):
        return np.array([sum(b < a for b in x) + (sum(b == a for b in x) + 1) / 2 for a in x])

    for h in (1, 2):
        x, y = zip(*[got[h, i] for i in range(1, 60 - h)])
        assert found[1, h].rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert (found[9, 1].rho, found[9, 1].p_value, found[9, 1].n_obs) == (None, 1.0, 0)
    p = spark.createDataFrame([(i, 0, 1, "t", x, 0.5, 30) for i, x in enumerate([0.01, 0.04, 0.03, 0.5])], "lag int, anchor int, horizon int, target_type string, p_value double, rho double, n_obs int")
    adjusted = lambda m: [r.adjusted_p_value for r in triplets.adjusted(p, m).orderBy("lag").collect()]
    assert adjusted("holm") == pytest.approx([0.04, 0.09, 0.09, 0.5]) and adjusted("bh") == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    chosen = triplets.selected(triplets.adjusted(p), least=20).where("selected")
    assert [r.lag for r in chosen.collect()] == [0]
    picks = triplets.selected(triplets.adjusted(estimates), alpha=1.0, least=3)
    train = rows.where("clock_index < 30 AND horizon = 1")
    scored = triplets.scores(rows.where("horizon = 1"), picks, train, "k").collect()
    moves = [got[1, i][0] for i in range(1, 30)]
    from statistics import NormalDist

    sign = 1 if found[1, 1].rho >= 0 else -1
    for r in scored:
        below = sum(m <= got[1, r.clock_index][0] for m in moves)
        assert r.score == pytest.approx(sign * NormalDist().inv_cdf((below + 0.5) / (len(moves) + 1)))
    assert len(scored) == 58
    total = triplets.aggregated(spark.createDataFrame([(0, "k", 1.0), (0, "k", None), (1, "k", 3.0)], "clock_index int, k string, score double"), "k").orderBy("clock_index").collect()
    assert [(r.triplet_signal, r.component_count) for r in total] == [(0.5, 2), (3.0, 1)]
