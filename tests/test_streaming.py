"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import replay
from marlstone.streaming import late
from tests.test_problems import CHANGES, feed, replayed

DATA = "/root/testdata/sf0.001/trace_trades.parquet"


def test_hourly_totals_as_stream(spark, tmp_path):
    pytest.importorskip("pyarrow")
    trades = spark.read.parquet(DATA)
    folder = str(tmp_path / "in")
    trades.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(trades.schema).parquet(folder)
    query = late.hourly_totals(stream, "400 days").writeStream.outputMode("update").format("memory").queryName("hours").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert query.awaitTermination(120)
    last = spark.table("hours").groupBy("bond_id", "hour").agg(F.max("n_trades").alias("n"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in late.hourly_totals(trades).select("bond_id", "hour", "n_trades").collect()}


@pytest.mark.parametrize("partial", [False])
def test_changes_in_batches(spark, partial):
    rows = feed(9, 200, 12)
    state = spark.createDataFrame([], CHANGES).drop("_key")
    for part in (rows[100:], rows[:150]):  # overlapping, in no order
        batch = spark.createDataFrame(part, CHANGES).drop("_key")
        state = spark.createDataFrame(late.apply_changes(state, batch, columns=("a", "b"), partial=partial).collect(), state.schema.simpleString()[7:-1].replace(":", " "))
    assert {tuple(r) for r in replay.replay(state, columns=("a", "b")).collect()} == replayed(rows, partial)
