"""Sinks: tables by month, bundles of tables, manifests and hashes."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_monthly(df: DataFrame, path: str, *, time: str = "timestamp_utc", rows_a_file: int = 5_000_000) -> None:
    """Zstandard Parquet by year and month. Rows are placed by month and hash of time, so a large month has many writers.

    Rows without a time go to year and month null. The commit protocol makes the write atomic by file.
    """
    out = df.withColumn("year", F.year(time)).withColumn("month", F.month(time))
    out.repartition("year", "month", F.pmod(F.xxhash64(time), F.lit(16))).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).partitionBy("year", "month").parquet(path)


def write_bundle(tables: dict[str, DataFrame | None], path: str) -> None:
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def read_bundle(spark: SparkSession, path: str, required: Iterable[str], optional: Iterable[str] = ()) -> dict[str, DataFrame | None]:
    """The bundle's tables; an optional one that is not there is None, a required one an error."""
    from pyspark.errors import AnalysisException

    out: dict[str, DataFrame | None] = {name: spark.read.parquet(f"{path}/{name}.parquet") for name in required}
    for name in optional:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}.parquet")
        except AnalysisException:
            out[name] = None
    return out


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """All scenarios below ``path`` (scenario=NAME/...) as one table with a ``scenario`` column; filters on it prune folders."""
    return spark.read.option("basePath", path).parquet(f"{path}/scenario=*")


def stable_hash(value: object) -> str:
    """SHA-256 of a value's JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def file_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_json(value: object, path: str) -> None:
    """Written beside its place and moved there, so that no reader sees a part."""
    with open(f"{path}.tmp", "w") as f:
        json.dump(value, f, sort_keys=True, indent=1, default=str)
    os.replace(f"{path}.tmp", path)


def manifest(files: Iterable[str], **extra: object) -> dict:
    """Size and hash of local files, and whatever else is given."""
    return {"files": {f: {"bytes": os.path.getsize(f), "sha256": file_hash(f)} for f in sorted(files)}, **extra}


def digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): the same for the same rows in any order. Every column counts, nulls apart from empty text."""
    text = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(c) for c in sorted(df.columns)]))
    parts = [F.conv(F.substring(F.sha2(text, 256), i, 8), 16, 10).cast("long") for i in (1, 9, 17, 25)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *[F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts]).alias("digest"))
