"""Checks of tables and their columns: on the plan where names suffice, by one aggregate where rows must be seen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a column or path that tells hidden truth is named by, and identifiers that no public table has; fixed values.
TRUTH_TOKENS = ("truth", "latent", "oracle", "planted", "hidden")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def forbid_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    found = sorted(set(names) & set(df.columns))
    if found:
        raise ValueError(f"forbidden columns: {found}")
    return df


def truth_like(columns: Iterable[str], tokens: Sequence[str] = TRUTH_TOKENS) -> list[str]:
    """Columns one of whose words is a truth token."""
    return [c for c in columns if any(t in c.lower().split("_") or c.lower().startswith(t) for t in tokens)]


def public_only(df: DataFrame, tokens: Sequence[str] = TRUTH_TOKENS) -> DataFrame:
    """``df`` if neither its columns nor the files it reads are named by a truth token."""
    found = truth_like(df.columns, tokens) + [f for f in df.inputFiles() if any(t in f.lower() for t in tokens)]
    if found:
        raise ValueError(f"not public: {found}")
    return df


def check_sides(df: DataFrame, column: str = "side") -> DataFrame:
    """``df`` if every side is -1, 0, 1 or null."""
    bad = df.where(~F.col(column).isin(-1, 0, 1)).select(column).limit(1).collect()
    if bad:
        raise ValueError(f"{column} holds {bad[0][0]!r}")
    return df


def structure(df: DataFrame, *, key: str, sides: str | None = None, positive: Sequence[str] = ()) -> DataFrame:
    """One row of counts: rows, null keys, keys beyond one row each, sides outside -1 and 1, and values not finite or not above 0.

    Repeats are counted by key first, so the count of distinct keys never gathers in one task.
    """
    per = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        *([F.sum((~F.coalesce(F.col(sides).isin(-1, 1), F.lit(False))).cast("long")).alias("_sides")] if sides else []),
        *[F.sum((~F.coalesce((F.col(c) > 0) & (F.abs(c) != float("inf")) & ~F.isnan(c), F.lit(False))).cast("long")).alias(f"_p_{c}") for c in positive],
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(
        total("n").alias("rows"), total(F.when(F.col(key).isNull(), F.col("n"))).alias("null_keys"), total(F.when(F.col(key).isNotNull(), F.col("n") - 1)).alias("repeats"),
        *([total("_sides").alias("bad_sides")] if sides else []), *[total(f"_p_{c}").alias(f"bad_{c}") for c in positive],
    )


def profile(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, null rate, distinct values, and least and greatest as text."""
    stats = [
        F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.count_distinct(F.col(c)).alias("n_distinct"),
            F.min(F.col(c)).cast("string").alias("least"), F.max(F.col(c)).cast("string").alias("greatest"),
        )
        for c in df.columns
    ]
    out = df.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))
    return out.withColumn("null_rate", F.try_divide(F.col("nulls"), F.col("rows")))
