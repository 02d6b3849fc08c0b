"""Point-in-time windows, as-of joins and the registered state operators, all inside Catalyst.

Streams are keyed by ``key`` and ordered by ``us``, microseconds. Frames are RANGE frames, so ties at one instant are in or
out together; a strict window ends one microsecond before. NULL is never zero; NaN is taken as NULL before it gets here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marlstone.operators import buckets

DAY = 86_400_000_000


def trailing(key: str, us: str, width: int, *, strict: bool = True) -> WindowSpec:
    """[t - width, t) where strict, else [t - width, t]."""
    return Window.partitionBy(key).orderBy(us).rangeBetween(-width, -1 if strict else 0)


def history(key: str, us: str, *, strict: bool = True) -> WindowSpec:
    return Window.partitionBy(key).orderBy(us).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)


def imbalance(side: str, size: Column, w: WindowSpec) -> Column:
    """Signed over absolute size of two-sided events; NULL without any."""
    sided = F.col(side).isin(-1, 1)
    return F.try_divide(F.sum(F.when(sided, F.col(side) * size)).over(w), F.sum(F.when(sided, F.abs(size))).over(w))


def last_n(df: DataFrame, key: str, us: str, value: str, n: int, tie: list[str]) -> DataFrame:
    """Sum and count of the last ``n`` values strictly before each row; ties at the row's instant do not count.

    Prefix sums are joined at the number of strictly earlier rows, so a row's cost does not depend on n. ``tie`` makes
    the order of rows at one instant total.
    """
    seq = buckets.numbered(df.select(key, us, *dict.fromkeys([*tie, value])), key, us, tie, {"_total": F.col(value)}).select(key, us, *tie, "_prior", "_row", "_total")
    totals = seq.select(F.col(key).alias("_k"), F.col("_row").alias("_at"), F.col("_total").alias("_sum"))
    end, begin = totals.alias("e"), totals.alias("b")
    low = F.col("_prior") - n
    out = seq.join(end, (F.col(key) == F.col("e._k")) & (F.col("_prior") == F.col("e._at")), "left")
    out = out.join(begin, (F.col(key) == F.col("b._k")) & (low == F.col("b._at")), "left")
    return out.select(key, us, *tie, F.least("_prior", F.lit(n)).alias("n_prior"), (F.col("e._sum") - F.coalesce("b._sum", F.lit(0.0))).alias("sum_prior"))


def as_of(left: DataFrame, right: DataFrame, key: str, us: str, value: str, *, strict: bool = False, forward: bool = False) -> DataFrame:
    """``left`` with the last (or, forward, the first) non-null ``value`` of ``right`` by then; several at one instant: the largest.

    Both streams are tagged and merged in windows of key and bucket, so no pair is formed and no task holds a key. A left
    row with a null key or time finds nothing.
    """
    picked = right.where(F.col(value).isNotNull() & F.col(key).isNotNull() & F.col(us).isNotNull()).groupBy(key, us).agg(F.max(value).alias("_value"))
    merged = left.withColumn("_value", F.lit(None).cast(dict(picked.dtypes)["_value"])).withColumn("_left", F.lit(True)).unionByName(picked.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    timed = merged.where(F.col(us).isNotNull())
    found = buckets.known(timed, key, us, F.col("_value"), strict=strict, forward=forward, name="_found")
    untimed = merged.where(F.col(us).isNull() & F.col("_left")).withColumn("_found", F.col("_value"))
    return found.where("_left").unionByName(untimed).withColumn(value, F.col("_found")).drop("_left", "_value", "_found")


def notional_clock(df: DataFrame, key: str, us: str, size: str, tie: list[str], amount: float) -> DataFrame:
    """How many rows, counted back from each row over all of the key's history, it takes until their absolute size is ``amount``.

    The row that crosses counts; NULL only where the whole history does not suffice. The walk ends behind the last row whose
    running total is at most the own total less ``amount``; both totals are merged in one window, so no pair is formed.
    Sizes are summed as decimals with twelve places, so that no total depends on the order of adding.
    """
    exact = F.abs(F.col(size)).cast("decimal(26,12)")
    rows = buckets.numbered(df.select(key, us, *tie, exact.alias("_size")), key, us, tie, {"_total": F.col("_size")})
    rows = rows.select(key, us, *tie, "_row", F.col("_total").cast("decimal(37,12)").alias("_total"))
    mark = F.struct(F.col("_total").alias("s"), F.col("_row").alias("at"))
    ask = F.struct((F.col("_total") - F.lit(amount).cast("decimal(26,12)")).cast("decimal(37,12)").alias("s"), F.lit(None).cast("long").alias("at"))
    merged = rows.withColumn("_m", F.explode(F.array(mark, ask))).withColumns({"_s": F.col("_m.s"), "_at": F.col("_m.at")})
    # buckets of the running total, chained like those of time; their width is the amount asked
    merged = merged.withColumn("_bucket", F.floor(F.col("_s") / amount).cast("long")).repartition(key, "_bucket")
    merged = buckets.chain(merged, key, {"_top": F.max("_at")}, lambda w: {"_carry": F.max("_top").over(w)})
    inside = F.max("_at").over(Window.partitionBy(key, "_bucket").orderBy("_s"))
    merged = merged.withColumn("_before", F.greatest(inside, "_carry"))
    return merged.where("_at IS NULL").select(key, us, *tie, F.when(F.col("_s") >= 0, F.col("_row") - F.coalesce("_before", F.lit(0))).cast("int").alias("events_needed"))


#: Half-lives a chunk of time, and how many chunks back a weight can still be told from 0 in a double (2 to the -1075).
CHUNK, FAR = 16, 69


def decayed_history(df: DataFrame, key: str, us: str, half_life_us: int, values: dict[str, Column]) -> DataFrame:
    """``df`` with each value's sum over all strictly earlier rows of the key, halved every half-life, a second of half-life.

    NULL where no earlier row has that value. History is cut into chunks of time whose totals are carried forward, so no
    task holds a key's rows and no weight overflows. Carrying ends where a weight is 0 in a double.
    """
    span = CHUNK * half_life_us
    rows = df.withColumn("_chunk", F.floor(F.col(us) / span).cast("long"))
    rows = rows.withColumn("_x", (F.col(us) - F.col("_chunk") * span) / half_life_us)
    grown = {n: F.when(F.col(key).isNotNull(), v.cast("double") * F.pow(F.lit(2.0), F.col("_x"))) for n, v in values.items()}
    totals = rows.groupBy(key, "_chunk").agg(*[f(g).alias(f"_{k}_{n}") for n, g in grown.items() for k, f in (("t", F.sum), ("n", F.count))])
    chain = Window.partitionBy(key).orderBy("_chunk")
    seen = F.collect_list(F.struct("_chunk", *[F.coalesce(f"_t_{n}", F.lit(0.0)).alias(n) for n in values])).over(chain.rangeBetween(-FAR, -1))

    def carried(n: str) -> Column:
        # by half the exponent twice, as the whole may be under the smallest double while the product is not
        half = lambda o: F.pow(F.lit(2.0), (o["_chunk"] - F.col("_chunk")) * F.lit(CHUNK / 2))
        return F.aggregate("_seen", F.lit(0.0), lambda s, o: s + o[n] * half(o) * half(o))

    carry = totals.withColumn("_seen", seen).select(
        F.col(key).alias("_k"), F.col("_chunk").alias("_c"),
        *[carried(n).alias(f"_c_{n}") for n in values], *[F.sum(f"_n_{n}").over(chain.rangeBetween(Window.unboundedPreceding, -1)).alias(f"_b_{n}") for n in values],
    )
    inside = Window.partitionBy(key, "_chunk").orderBy(us).rangeBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_{k}_{n}": f(g).over(inside) for n, g in grown.items() for k, f in (("l", F.sum), ("m", F.count))})
    out = local.join(carry, (F.col(key) == F.col("_k")) & (F.col("_chunk") == F.col("_c")), "left")
    zero = F.lit(0.0)
    decayed = {
        n: F.when(F.col(f"_m_{n}") + F.coalesce(f"_b_{n}", F.lit(0)) > 0, (F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_c_{n}", zero)) * F.pow(F.lit(2.0), -F.col("_x")) / max(half_life_us / 1e6, 1.0))
        for n in values
    }
    return out.select(*df.columns, *[c.alias(n) for n, c in decayed.items()])


def run_length(df: DataFrame, key: str, us: str, side: str, tie: list[str]) -> DataFrame:
    """Signed length of the run of one side that ends with each two-sided row."""
    rows = buckets.numbered(df.where(F.col(side).isin(-1, 1)).select(key, us, side, *tie), key, us, tie)
    order = Window.partitionBy(key, "_bucket").orderBy("_row")
    mark = F.struct(F.col("_row").alias("r"), F.col(side).alias("s"))
    rows = buckets.chain(buckets.placed(rows, key, us), key, {"_tail": F.max(mark)}, lambda w: {"_last": F.last("_tail").over(w)})
    rows = rows.withColumn("_new", F.when(F.coalesce(F.lag(side).over(order), F.col("_last.s")) == F.col(side), None).otherwise(F.col("_row")))
    rows = buckets.chain(rows, key, {"_begun": F.max("_new")}, lambda w: {"_since": F.max("_begun").over(w)})
    begun = F.coalesce(F.max("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("_since"))
    return rows.select(key, us, *tie, ((F.col("_row") - begun + 1) * F.col(side)).cast("int").alias("run_length"))


def simple_operators(v: str, side: str, weight: str, us: str, w: WindowSpec, seconds: float) -> dict[str, Column]:
    """The state operators that are plain aggregates of a window."""
    sided, heavy = F.col(side).isin(-1, 1), F.when((F.col(weight) > 0) & F.col(v).isNotNull(), F.col(weight))
    weighted = F.try_divide(F.sum(F.col(v) * heavy).over(w), F.sum(heavy).over(w))
    n = F.count(F.lit(1)).over(w)
    return {
        "count": n,
        "signed_count": F.coalesce(F.sum(F.when(sided, F.col(side))).over(w), F.lit(0)),
        "sum": F.sum(v).over(w),
        "signed_sum": F.sum(F.when(sided, F.col(v) * F.col(side))).over(w),
        "mean": F.avg(v).over(w),
        "weighted_mean": weighted,
        "vwap": weighted,
        "min": F.min(v).over(w),
        "max": F.max(v).over(w),
        "first": F.min(F.when(F.col(v).isNotNull(), F.struct(us, v))).over(w)[v],
        "last": F.max(F.when(F.col(v).isNotNull(), F.struct(us, v))).over(w)[v],
        "std": F.when(F.count(v).over(w) > 1, F.stddev_samp(v).over(w)),
        "time_since_last_event": (F.col(us) - F.max(us).over(w)) / 1e6,
        "intensity": n / seconds,
    }


def _middle(values: Column, p: float = 0.5) -> Column:
    """Percentile of a sorted array by linear interpolation."""
    at = (F.size(values) - 1) * F.lit(p)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.when(F.size(values) > 0, F.get(values, low) + (F.get(values, high) - F.get(values, low)) * (at - F.floor(at)))


def robust_operators(df: DataFrame, v: str, x: str, us: str, w: WindowSpec, half_life_seconds: float) -> DataFrame:
    """``df`` with the state operators that need a window's values at once: choose windows of bounded length.

    Intermediate arrays are columns of their own, so that each is made once.
    """
    seen = F.filter(F.collect_list(F.struct(F.col(us).alias("t"), F.col(v).alias("v"), F.col(x).alias("x"))).over(w), lambda o: o["v"].isNotNull())
    rows = df.withColumn("_seen", F.array_sort(seen))
    rows = rows.withColumns({"_v": F.transform("_seen", lambda o: o["v"]), "_x": F.transform("_seen", lambda o: o["x"])})
    rows = rows.withColumns({"_sorted": F.array_sort("_v"), "_sorted_x": F.array_sort("_x"), "_last": F.get("_v", F.size("_v") - 1)})
    rows = rows.withColumns({"_mid": _middle(F.col("_sorted")), "_mid_x": _middle(F.col("_sorted_x"))})
    slopes = F.flatten(
        F.transform("_seen", lambda a, i: F.transform(F.filter(F.slice("_seen", i + 2, F.size("_seen")), lambda b: b["x"] != a["x"]), lambda b: (b["v"] - a["v"]) / (b["x"] - a["x"])))
    )
    rows = rows.withColumns(
        {
            "_off": F.array_sort(F.transform("_v", lambda a: F.abs(a - F.col("_mid")))),
            "_off_x": F.array_sort(F.transform("_x", lambda a: F.abs(a - F.col("_mid_x")))),
            "_both": F.array_sort(F.transform("_seen", lambda o: (o["v"] - F.col("_mid")) * (o["x"] - F.col("_mid_x")))),
            "_slopes": F.array_sort(slopes),
        }
    )
    rows = rows.withColumns({"mad": _middle(F.col("_off")), "_mad_x": _middle(F.col("_off_x")), "robust_covariance": _middle(F.col("_both")), "robust_slope": _middle(F.col("_slopes"))})
    decay = lambda o: F.exp(-F.lit(0.6931471805599453) * (F.col(us) - o["t"]) / 1e6 / half_life_seconds)
    total = lambda f: F.aggregate("_seen", F.lit(0.0), lambda s, o: s + f(o))
    spread = F.col("mad") * F.col("_mad_x")
    return rows.withColumns(
        {
            "percentile_25": _middle(F.col("_sorted"), 0.25),
            "percentile_50": F.col("_mid"),
            "ewma": F.try_divide(total(lambda o: decay(o) * o["v"]), total(decay)),
            "robust_correlation": F.when(spread != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("robust_covariance") / spread))),
            "rolling_rank": F.try_divide(F.size(F.filter("_v", lambda a: a <= F.col("_last"))) - F.lit(0.5), F.size("_v")),
        }
    ).drop("_seen", "_v", "_x", "_sorted", "_sorted_x", "_last", "_mid", "_mid_x", "_off", "_off_x", "_both", "_slopes", "_mad_x")
