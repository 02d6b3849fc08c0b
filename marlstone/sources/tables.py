"""Parquet scans and the small column policies that every query shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch, also for a timestamp without zone (taken as UTC)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def plain_id(c: Column | str) -> Column:
    """Ids compare without regard to case and surrounding blanks."""
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL: missing is never zero and never NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
