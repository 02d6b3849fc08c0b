"""The default cut-off of the streaming totals is the one of the batch, though rows come in many batches."""

import datetime as dt

from pyspark.sql import functions as F

from marlstone.operators import late as batch
from marlstone.streaming import late
from tests.test_problems import TRADE, trade


def test_cut_off_by_arrival(spark, tmp_path):
    rows = [
        trade("early", 31), trade("other hour", 130, at=125), trade("kept", 131), trade("kept", 132), trade("by publication", None, 170), trade("newest", 175, at=174),
        trade("in time", 179, at=1), trade("limit", 180), trade("gone", 190), trade("never", None), trade("next", 400, at=390), trade("old", 401, at=20), trade("bondless", 402, bond=None, at=395),
    ]
    df = spark.createDataFrame(rows, TRADE).withColumn("period", F.lit(0))
    for i, row in enumerate(rows):  # one file for each row, in order of arrival
        spark.createDataFrame([row], TRADE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = late.hourly_totals(stream).writeStream.outputMode("update").format("memory").queryName("cut").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert query.awaitTermination(120)
    got = {(r.bond_id, r.hour): (r.n, r.v) for r in spark.table("cut").groupBy("bond_id", "hour").agg(F.max("n_trades").alias("n"), F.max("notional").alias("v")).collect()}
    want = {}
    for r in sorted(batch.triangle(df).collect(), key=lambda r: r.revision):
        want[r.bond_id, dt.datetime.strptime(r.hour, "%Y-%m-%d %H:%M")] = (r.n_trades, r.notional)
    assert got == want and sum(n for n, _ in want.values()) == 7
    assert {(r.bond_id, r.hour): (r.n_trades, r.notional) for r in late.hourly_totals(df).collect()} == want
