"""Tapes of trades: aliases of columns, sizes and sides as printed, and the views queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.tables import finite, micros, table

#: Headers of public trade files by canonical name; fixed values.
ALIASES = {
    "cusip": ("cusip", "cusip_id"),
    "ts": ("ts", "execution date/time", "execution_datetime", "date_time"),
    "price": ("price",),
    "par_volume": ("par_volume", "quantity", "volume", "reported_volume"),
    "side_flag": ("side_flag", "side"),
    "contra_party_type": ("contra_party_type", "contra party type"),
}
#: Spellings of a dealer tape's sides, the client selling to the dealer +1; fixed values.
TAPE_SIDES = {1: ("1", "+1", "buy", "b", "customer sell", "client sell", "client sells"), -1: ("-1", "sell", "s", "customer buy", "client buy", "client buys")}
#: Spellings of a customer's side, the customer buying +1; fixed values.
CUSTOMER_SIDES = {
    1: ("1", "buy", "b", "customer_buy", "client_buy", "client buys", "customer buys"),
    -1: ("-1", "sell", "s", "customer_sell", "client_sell", "client sells", "customer sells"),
}


def parse_size(c: Column) -> Column:
    """Sizes as printed: '5MM+', '$1,000', '2K', '1M' (M and MM both a million). What is no number gives NULL."""
    text = F.upper(F.regexp_replace(F.trim(c), r"[$,\s+]", ""))
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)(?:MM|M|K|B)?$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"(MM|M|K|B)$", 1)
    return number * F.when(unit.isin("MM", "M"), 1e6).when(unit == "K", 1e3).when(unit == "B", 1e9).otherwise(1.0)


def tape_side(c: Column) -> Column:
    """Sides of a dealer tape as text: '1', '-1', 'unknown' for null, and any other text in lower case as it stands."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*TAPE_SIDES[1]), "1").when(text.isin(*TAPE_SIDES[-1]), "-1").otherwise(F.coalesce(text, F.lit("unknown")))


def customer_side(c: Column, *, strict: bool = False) -> Column:
    """Sides of the library: the customer buying is +1, selling -1. Unknown text and null give NULL, or an error where ``strict``."""
    text = F.lower(F.trim(c.cast("string")))
    unknown = F.raise_error(F.concat(F.lit("no customer side: "), F.coalesce(text, F.lit("null")))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(text.isin(*CUSTOMER_SIDES[1]), 1).when(text.isin(*CUSTOMER_SIDES[-1]), -1).otherwise(unknown)


def read_csv_tape(spark: SparkSession, path: str) -> DataFrame:
    """A public CSV tape with canonical names. Columns without a known alias are dropped; a missing side or contra party is
    'unknown', another missing column an error. Times and prices that are none are an error, as are sizes with other text."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in raw.columns}
    picked = {k: next((F.col(f"`{names[a]}`") for a in options if a in names), None) for k, options in ALIASES.items()}
    missing = [k for k, c in picked.items() if c is None and k not in ("side_flag", "contra_party_type")]
    if missing:
        raise ValueError(f"the tape lacks {missing}")
    unknown = F.lit("unknown")
    return raw.select(
        picked["cusip"].alias("cusip"), F.to_timestamp(picked["ts"]).alias("ts"), picked["price"].cast("double").alias("price"), parse_size(picked["par_volume"]).alias("par_volume"),
        (unknown if picked["side_flag"] is None else tape_side(picked["side_flag"])).alias("side_flag"),
        (unknown if picked["contra_party_type"] is None else F.lower(F.coalesce(picked["contra_party_type"], F.lit("nan")))).alias("contra_party_type"),
    ).orderBy("ts", "cusip")


def read_jdbc_tape(spark: SparkSession, url: str, *, trades: str, bonds: str, start: str, end: str, cusips: list[str] | None = None, **options: str) -> DataFrame:
    """Trades with their bond's reference columns from a database: dates and universe are filters that Spark pushes into the
    source's SQL, bonds are joined left, so a trade of an unlisted bond stays."""
    read = lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return joined_tape(read(trades), read(bonds), start=start, end=end, cusips=cusips)


def joined_tape(trades: DataFrame, bonds: DataFrame, *, start: str, end: str, cusips: list[str] | None = None) -> DataFrame:
    rows = trades.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if cusips is not None:
        rows = rows.where(F.col("cusip").isin(*cusips))
    return rows.join(bonds, "cusip", "left")


def load_tape(spark: SparkSession, source: dict) -> DataFrame:
    """A tape from the kind of source named by ``source['type']``: 'csv', 'jdbc' or 'parquet'; the rest are its arguments."""
    kind, rest = source.get("type"), {k: v for k, v in source.items() if k != "type"}
    readers = {"csv": read_csv_tape, "jdbc": read_jdbc_tape, "parquet": lambda spark, path: spark.read.parquet(path)}
    if kind not in readers:
        raise ValueError(f"no source of type {kind!r}; there are {sorted(readers)}")
    return readers[kind](spark, **rest)


def first_existing(df: DataFrame, *names: str) -> Column:
    """The first non-null value of those of ``names`` that ``df`` has."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def normalise_requests(df: DataFrame) -> DataFrame:
    """Requests: size (else notional) as notional, numbers that are none NULL, event_kind from the stage (default inquiry) in lower case."""
    out = df.withColumn("side", F.col("side").try_cast("double")).withColumn("notional", (F.col("size") if "size" in df.columns else first_existing(df, "notional")).try_cast("double"))
    if "event_kind" not in df.columns:
        stage = F.col("stage") if "stage" in df.columns else first_existing(df, "rfq_stage")
        out = out.withColumn("event_kind", F.lower(F.coalesce(stage.cast("string"), F.lit("inquiry"))))
    return out


def normalise_quotes(df: DataFrame) -> DataFrame:
    """Quotes: spread and mid are derived from bid and ask only where the column is absent."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in ("bid", "ask", "mid", "spread", "source_disagreement") if c in df.columns})
    if {"bid", "ask"} <= set(df.columns):
        if "spread" not in df.columns:
            out = out.withColumn("spread", F.col("ask") - F.col("bid"))
        if "mid" not in df.columns:
            out = out.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    return out


def of_kind(df: DataFrame, *kinds: str) -> DataFrame:
    """Rows whose event_kind is one of ``kinds``, whatever its case; none where the column is missing."""
    return df.where(F.lower(F.col("event_kind").cast("string")).isin(*[k.lower() for k in kinds])) if "event_kind" in df.columns else df.limit(0)


def firm_inquiry(df: DataFrame) -> Column:
    """Whether a request is firm by its kind or its request type."""
    firm = ("firm_inquiry", "firm inquiry", "firm")
    by = [F.lower(F.col(c).cast("string")).isin(*firm) for c in ("event_kind", "request_type") if c in df.columns]
    return F.coalesce(F.greatest(*by) if len(by) > 1 else by[0] if by else F.lit(False), F.lit(False))


def inventory_change(side: Column, notional: Column) -> Column:
    """The dealer's inventory moves against the customer: -side * notional; a negative notional is an error."""
    return F.when(notional < 0, F.raise_error(F.lit("negative notional")).cast("double")).otherwise(-side * notional)


def tape(spark: SparkSession, d: str) -> DataFrame:
    """The event stream as a tape: bond, issuer, us, id, kind, side and amount."""
    side = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type").isin("click", "error"), -1).otherwise(0)
    return table(spark, d, "events").select(
        F.col("user_id").alias("bond"), (F.col("user_id") % 10).alias("issuer"), micros("ts").alias("us"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), side.alias("side"), finite("value").alias("amount")
    )


def trades(spark: SparkSession, d: str) -> DataFrame:
    """Customer trades with two sides: distinct trades with bond, time, price and size."""
    rows = table(spark, d, "trace_trades").select("trade_id", F.col("bond_id").alias("bond"), micros("source_event_time").alias("us"), finite("price").alias("price"), finite("notional").alias("size"), F.coalesce(F.col("customer_side"), F.lit(0)).alias("side"))
    return rows.where("trade_id IS NOT NULL AND bond IS NOT NULL AND us IS NOT NULL AND price IS NOT NULL").distinct()
