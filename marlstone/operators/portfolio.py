"""Cross-sections into weights and positions. A group is one instant's cross-section, so its size is that of the universe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.tables import finite


def _zero() -> Column:
    return F.lit(0.0)


def normalised(c: Column, groups: Sequence[str], gross: float = 1.0, *, empty: float | None = 0.0) -> Column:
    """``c`` scaled so that a group's absolute sum is ``gross``; ``empty`` (or NULL) where that sum is 0."""
    total = F.sum(F.abs(c)).over(Window.partitionBy(*groups))
    return F.when(total > 0, c * gross / total).otherwise(F.lit(empty).cast("double"))


def rank_long_short(signal: Column, groups: Sequence[str], ties: Sequence[str]) -> Column:
    """The lower half of the finite signals at -1/k, the upper at 1/k, a middle one and the rest at 0; ties by ``ties``."""
    w = Window.partitionBy(*groups)
    value = finite(signal)
    n = F.count(value).over(w)
    r, k = F.row_number().over(w.orderBy(value.asc_nulls_last(), *ties)), F.floor(n / 2)
    side = F.when(value.isNull() | (n < 2), 0).when(r <= k, -1).when(r > n - k, 1).otherwise(0)
    return F.when(side == 0, _zero()).otherwise(side / k)


def target_positions(
    df: DataFrame, *, signal: str, instrument: str, groups: Sequence[str], method: str = "rank_long_short", risk: str | None = None, gross: float = 1.0,
    cap: float | None = None, cap_column: str | None = None, ties: Sequence[str] = (),
) -> DataFrame:
    """``df`` with target_weight, risk_unit_value, target_exposure, target_position, realized_gross_exposure and
    portfolio_quality_flag.

    ``risk`` is the column of notional, dv01 or cr01 a position is divided by (one unit each without it); where it is not
    above 0 the position is 0. Caps bound positions, a bad cap is 0. Null and infinite signals take no part.
    """
    if gross < 0 or (cap is not None and cap < 0):
        raise ValueError("gross and cap are not negative")
    w = Window.partitionBy(*groups)
    raw = rank_long_short(F.col(signal), groups, [instrument, *ties]) if method == "rank_long_short" else F.coalesce(finite(signal), _zero())
    if method not in ("rank_long_short", "signal_proportional"):
        raise ValueError(f"no method {method!r}")
    rows = df.withColumn("_raw", raw).withColumn("_exposure", normalised(F.col("_raw"), groups, gross))
    unit = F.abs(F.col(risk).cast("double")) if risk else F.lit(1.0)
    rows = rows.withColumn("risk_unit_value", F.when((unit > 0) & (unit < float("inf")) & ~F.isnan(unit), unit))
    position = F.coalesce(F.col("_exposure") / F.col("risk_unit_value"), _zero())
    caps = ([F.lit(float(cap))] if cap is not None else []) + ([F.coalesce(finite(F.abs(F.col(cap_column).cast("double"))), _zero())] if cap_column else [])
    if caps:
        least = F.least(*caps) if len(caps) > 1 else caps[0]
        position = F.greatest(F.least(position, least), -least)
    rows = rows.withColumn("target_position", position).withColumn("target_exposure", F.col("target_position") * F.coalesce("risk_unit_value", _zero()))
    rows = rows.withColumn("realized_gross_exposure", F.sum(F.abs("target_exposure")).over(w))
    rows = rows.withColumn("target_weight", F.when(F.col("realized_gross_exposure") > 0, F.col("target_exposure") / F.col("realized_gross_exposure")).otherwise(_zero()))
    flag = (
        F.when(F.count(finite(signal)).over(w) == 0, "flat_no_valid_signals").when(F.col("realized_gross_exposure") <= 0, "flat_after_scaling")
        .when(F.max(F.col("risk_unit_value").isNull()).over(w), "partial_invalid_risk_unit").when(F.max(F.abs("target_position")).over(w) == 0, "flat_after_caps").otherwise("ok")
    )
    return rows.withColumn("portfolio_quality_flag", flag).drop("_raw", "_exposure")


def eligible(signal: Column, mask: Column | None) -> Column:
    return signal if mask is None else F.when(F.coalesce(mask, F.lit(False)), signal)


def inverse_volatility(signal: Column, volatility: Column, groups: Sequence[str], gross: float = 1.0, mask: Column | None = None) -> Column:
    """Signs over volatility; what has neither counts as 0, a group without any as NULL."""
    raw = finite(F.signum(eligible(signal, mask)) / F.when(volatility != 0, volatility))
    return normalised(F.coalesce(raw, _zero()), groups, gross, empty=None)


def proportional(signal: Column, groups: Sequence[str], gross: float = 1.0, volatility: Column | None = None, power: float = 0.0, mask: Column | None = None) -> Column:
    raw = eligible(signal, mask)
    if volatility is not None and power:
        raw = raw / F.pow(F.when(volatility != 0, volatility), F.lit(power))
    return normalised(F.coalesce(finite(raw), _zero()), groups, gross, empty=None)


def rank_halves(signal: Column, groups: Sequence[str], ties: Sequence[str], gross: float = 1.0, mask: Column | None = None) -> Column:
    """Equal weights, the upper half long and the lower short; NULL with fewer than two signals."""
    w, value = Window.partitionBy(*groups), eligible(signal, mask)
    n = F.count(value).over(w)
    r = F.row_number().over(w.orderBy(value.asc_nulls_last(), *ties))
    side = F.when(value.isNull(), 0).when(r > (n + 1) / 2, 1).when(r < (n + 1) / 2, -1).otherwise(0)
    size = 2 * F.floor(n / 2)
    return F.when(n >= 2, side * gross / size)


def linear_halves(df: DataFrame, signal: str, groups: Sequence[str], gross: float = 1.0, name: str = "weight") -> DataFrame:
    """Centred average ranks scaled to ``gross``; null signals get 0."""
    w, value = Window.partitionBy(*groups), F.col(signal)
    same = F.count(value).over(Window.partitionBy(*groups, signal))
    rank = F.rank().over(w.orderBy(value.asc_nulls_last())) + (same - 1) / 2
    out = df.withColumn("_centred", F.when(value.isNotNull(), rank - (F.count(value).over(w) + 1) / 2))
    return out.withColumn(name, F.coalesce(normalised(F.col("_centred"), groups, gross, empty=None), _zero())).drop("_centred")


def beta_neutral(df: DataFrame, weight: str, beta: str, groups: Sequence[str], gross: float | None = None, name: str = "neutral_weight") -> DataFrame:
    """Weights less their projection on beta; null betas count as 0."""
    w, b = Window.partitionBy(*groups), F.coalesce(F.col(beta), _zero())
    shift = F.try_divide(F.sum(F.col(weight) * b).over(w), F.sum(b * b).over(w))
    out = df.withColumn(name, F.col(weight) - b * F.coalesce(shift, _zero()))
    return out if gross is None else out.withColumn(name, normalised(F.col(name), groups, gross, empty=None))


def bounded(df: DataFrame, weight: str, groups: Sequence[str], *, lower: float = -0.05, upper: float = 0.05, gross: float | None = None, rounds: int = 20, name: str = "bounded_weight") -> DataFrame:
    """Weights inside bounds, and with ``gross`` scaled to it and bounded again up to ``rounds`` times, until nothing moves.

    A cross-section is one row meanwhile: as many values as there are instruments.
    """
    clip = lambda c: F.greatest(F.lit(lower), F.least(F.lit(upper), c))
    if gross is None:
        return df.withColumn(name, clip(F.col(weight)))
    start = F.transform("_rows", lambda r: clip(F.coalesce(r[weight], _zero())))

    def again(a: Column, _: Column) -> Column:
        total = F.aggregate(a, _zero(), lambda s, x: s + F.abs(x))
        return F.when(total > 0, F.transform(a, lambda x: clip(x * gross / total))).otherwise(a)

    packed = df.groupBy(*groups).agg(F.collect_list(F.struct(*df.columns)).alias("_rows")).withColumn("_w", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again))
    return packed.select(F.inline(F.arrays_zip("_rows", "_w"))).select("_rows.*", F.col("_w").alias(name))


def tranches(df: DataFrame, weight: str, instrument: str, time: str, count: int, name: str = "tranche_weight") -> DataFrame:
    """(instrument, time, mean of the weights of the last ``count`` times), times without a row counting as 0.

    Each weight goes to the ``count`` times it acts on, by number of time; only the list of times is ordered globally.
    """
    if count <= 0:
        raise ValueError("count is above 0")
    times = df.select(time).distinct().withColumn("_n", F.row_number().over(Window.orderBy(time)))
    spread = df.join(times, time).select(instrument, F.coalesce(weight, _zero()).alias("_w"), F.explode(F.sequence(F.col("_n"), F.col("_n") + count - 1)).alias("_n"))
    return spread.groupBy(instrument, "_n").agg((F.sum("_w") / count).alias(name)).join(times, "_n").select(instrument, time, name)


def hysteresis(df: DataFrame, signal: str, instrument: str, time: str, *, enter: float, exit: float, name: str = "position") -> DataFrame:
    """Positions that open where a signal's size reaches ``enter`` and close where it falls under ``exit``, else stay.

    A position is that of the last decisive row, so nothing recurs: rows in between carry it. A turn of sign while open closes.
    """
    s = F.col(signal)
    w = Window.partitionBy(instrument).orderBy(time)
    decisive = F.when(F.abs(s) >= enter, F.signum(s)).when(s.isNull() | (F.abs(s) < exit), _zero())
    held = df.withColumn("_held", F.coalesce(F.last(decisive, ignorenulls=True).over(w), _zero()))
    return held.withColumn(name, F.col("_held")).drop("_held")


def dispersion_scaled(signal: Column, groups: Sequence[str], least: float = 1e-12) -> Column:
    spread = F.stddev_samp(signal).over(Window.partitionBy(*groups))
    return F.when(spread > least, signal / spread)


def residualised(df: DataFrame, y: str, x: str, instrument: str, name: str = "residual") -> DataFrame:
    """``y`` less its least-squares line on ``x`` per instrument; the sums are joined back, not collected."""
    fit = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(instrument).agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_level"))
    return df.join(fit, instrument, "left").withColumn(name, F.col(y) - F.col("_level") - F.col("_slope") * F.col(x)).drop("_slope", "_level")
