"""Evaluation of probabilities and small models, from tables of distinct scores: no step orders all rows in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.skew import value_bucket

EDGE = 1e-12


def scores(df: DataFrame, p: str, y: str) -> DataFrame:
    """Distinct scores (s) with their rows (m) and positives (p), those with smaller scores (m_below, p_below), and all (m_all, p_all)."""
    value = F.greatest(F.least(F.col(p).cast("double"), F.lit(1 - EDGE)), F.lit(EDGE))
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(value.alias("s")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(y).cast("long")).alias("p"))
    rows = rows.withColumn("_b", value_bucket(F.col("s"), 1024))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over value buckets, at most 1,025 of them
    base = rows.groupBy("_b").agg(F.sum("m").alias("_m"), F.sum("p").alias("_p")).select("_b", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}0") for c in "mp"], *[F.sum(f"_{c}").over(Window.partitionBy()).alias(f"{c}_all") for c in "mp"])
    w = Window.partitionBy("_b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(base, "_b").select("s", "m", "p", "m_all", "p_all", *[(F.col(f"_{c}0") + F.sum(c).over(w) - F.col(c)).alias(f"{c}_below") for c in "mp"])


def bins(df: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed: rows, mean score and rate."""
    b = F.least(F.floor(F.col("s") * n), F.lit(n - 1)).alias("bin")
    return scores(df, p, y).groupBy(b).agg(F.sum("m").alias("n"), (F.sum(F.col("s") * F.col("m")) / F.sum("m")).alias("mean_score"), (F.sum("p") / F.sum("m")).alias("rate"))


def deciles(df: DataFrame, p: str, y: str, ties: Sequence[str], n: int = 10) -> DataFrame:
    """Buckets by rank, ties by ``ties``, cut at the ranks' linear quantiles, right-closed: row_count, mean_probability, event_rate."""
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("_b", value_bucket(F.col(p), 1024))
    base = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    base = base.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy(p, *ties))
    q = F.least(F.lit(n), F.col("_all"))
    cut = F.greatest(F.ceil((rank - 1) * q / F.greatest(F.col("_all") - 1, F.lit(1))), F.lit(1))
    placed = rows.join(base, "_b").withColumn("bucket", cut)
    return placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("row_count"), F.avg(p).alias("mean_probability"), F.avg(F.col(y).cast("double")).alias("event_rate"))


def binary_metrics(df: DataFrame, p: str, y: str, threshold: float = 0.5, n_bins: int = 10) -> DataFrame:
    """One row: n, positives, log_loss, brier, roc_auc, pr_auc, ece and the confusion matrix. AUCs of one class are NULL."""
    s, m, pos = F.col("s"), F.col("m"), F.col("p")
    # precision at each distinct score, taken from above
    precision = (F.col("p_all") - F.col("p_below")) / (F.col("m_all") - F.col("m_below"))
    own = F.least(F.floor(s * n_bins), F.lit(n_bins - 1))
    gaps = [F.abs(F.coalesce(F.sum(F.when(own == i, pos - s * m)), F.lit(0.0))) for i in range(n_bins)]
    one = scores(df, p, y).agg(
        F.coalesce(F.sum(m), F.lit(0)).alias("n"), F.coalesce(F.sum(pos), F.lit(0)).alias("positives"), F.sum(-(pos * F.log(s) + (m - pos) * F.log(1 - s))).alias("loss"),
        F.sum(pos * (1 - s) ** 2 + (m - pos) * s**2).alias("square"), F.sum(pos * (F.col("m_below") - F.col("p_below") + (m - pos) / 2)).alias("pairs"), F.sum(pos * precision).alias("area"), sum(gaps).alias("gap"),
        *[F.coalesce(F.sum(F.when(c, v)), F.lit(0)).alias(k) for k, c, v in (("tn", s < threshold, m - pos), ("fp", s >= threshold, m - pos), ("fn", s < threshold, pos), ("tp", s >= threshold, pos))],
    )
    n, k = F.col("n"), F.col("positives")
    both = (k > 0) & (k < n)
    return one.select(
        "n", "positives", F.try_divide("loss", n).alias("log_loss"), F.try_divide("square", n).alias("brier"), F.when(both, F.col("pairs") / (k * (n - k))).alias("roc_auc"), F.when(both, F.col("area") / k).alias("pr_auc"),
        F.when(n > 0, F.col("gap") / n).alias("ece"), "tn", "fp", "fn", "tp",
    )


def calibration_line(df: DataFrame, p: str, y: str, rounds: int = 12, ridge: float = 1e-6) -> tuple[float, float] | None:
    """Intercept and slope of a logistic fit on the scores' logits by Newton's method: five sums come back a round, no rows."""
    table = scores(df, p, y).withColumn("x", F.log(F.col("s") / (1 - F.col("s"))))
    n, k = table.agg(F.sum("m"), F.sum("p")).first()
    if not n or k in (0, n):
        return None
    a, b = 0.0, 0.0
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        g, v = F.col("p") - F.col("m") * q, F.col("m") * q * (1 - q)
        row = table.agg(F.sum(g), F.sum(g * F.col("x")), F.sum(v), F.sum(v * F.col("x")), F.sum(v * F.col("x") ** 2)).first()
        step = np.linalg.solve(np.array([[row[2], row[3]], [row[3], row[4] + ridge]]), np.array([row[0], row[1] - ridge * b]))
        a, b = a + float(step[0]), b + float(step[1])
        if abs(step).max() < 1e-12:
            break
    return a, b


def ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> dict[str, float]:
    """Ridge weights with a free intercept, from one pass of Gram sums. Rows with a null take no part."""
    names = [*features, target]
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = rows.agg(F.count(F.lit(1)), *[F.sum(F.col(c).cast("double")) for c in names], *[F.sum(F.col(names[i]).cast("double") * F.col(names[j])) for i, j in pairs]).first()
    n = row[0]
    if not n:
        return {}
    mean = np.array([row[1 + i] for i in range(len(names))]) / n
    gram = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, row[1 + len(names) :]):
        gram[i, j] = gram[j, i] = v - n * mean[i] * mean[j]
    k = len(features)
    w = np.linalg.solve(gram[:k, :k] + alpha * np.eye(k), gram[:k, k])
    return {"intercept": float(mean[k] - w @ mean[:k]), **{f: float(x) for f, x in zip(features, w)}}


def linear_score(weights: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in weights.items() if c != "intercept"), F.lit(weights.get("intercept", 0.0)))


def logistic(df: DataFrame, features: Sequence[str], target: str, c: float = 1.0):
    """Median-imputed, scaled logistic regression; the penalty is that of a factor ``c`` on the loss summed over rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    n = df.count()
    steps = [
        Imputer(strategy="median", inputCols=list(features), outputCols=[f"_i_{f}" for f in features]), VectorAssembler(inputCols=[f"_i_{f}" for f in features], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=target, regParam=1 / (c * max(n, 1)), standardization=False, maxIter=200, tol=1e-9),
    ]
    return Pipeline(stages=steps).fit(df)


def predicted(model, df: DataFrame, name: str = "probability") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    keep = df.columns
    out = model.transform(df)
    return out.withColumn("_p", vector_to_array("probability")[1]).select(*keep, F.col("_p").alias(name))


def conditional_rate(train: DataFrame, test: DataFrame, by: str, y: str, name: str = "probability") -> DataFrame:
    """The train rows' rate at each value of ``by``, the overall rate (0.5 without rows) where that value is new."""
    rates = train.where(F.col(y).isNotNull()).groupBy(by).agg(F.avg(F.col(y).cast("double")).alias("_r"))
    overall = train.agg(F.avg(F.col(y).cast("double"))).first()[0]
    clipped = F.greatest(F.least(F.coalesce("_r", F.lit(0.5 if overall is None else float(overall))), F.lit(1 - EDGE)), F.lit(EDGE))
    return test.join(rates, by, "left").withColumn(name, clipped).drop("_r")


def chronological(df: DataFrame, time: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """``df`` with ``split``, cut between distinct times; the table of times alone is ordered."""
    times = df.select(time).where(F.col(time).isNotNull()).distinct()
    i, n = F.row_number().over(Window.orderBy(time)) - 1, F.count(F.lit(1)).over(Window.partitionBy())
    named = times.withColumn("split", F.when(i < F.floor(n * train), "train").when(i < F.floor(n * (train + validation)), "validation").otherwise("test"))
    return df.join(named, time)


def guard(df: DataFrame, at: str, known: Sequence[str] = (), labels: Sequence[str] = ()) -> DataFrame:
    """``df`` if no feature time in ``known`` lies after the prediction and no label time in ``labels`` at or before it."""
    late = [F.col(c) > F.col(at) for c in known] + [F.col(c) <= F.col(at) for c in labels]
    for c in late:
        if df.where(c).limit(1).collect():
            raise ValueError(f"not as known at prediction: {c}")
    return df


def blend(*columns: str) -> Column:
    """Mean of the non-null values of a row."""
    there = [F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c)) for c in columns]
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in there), F.lit(0.0)), sum((c.isNotNull().cast("int") for c in there), F.lit(0)))


def t_survival(t: float, n: int) -> float:
    """Two-sided p-value of Student's t with ``n`` degrees of freedom, by the continued fraction of the incomplete beta."""
    x, a, b = n / (n + t * t), n / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        out = d
        for m in range(1, 400):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + top * d), 1 + top / c
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return out

    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1 - front * fraction(1 - x, b, a) / b
