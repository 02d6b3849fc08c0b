"""Every query with SQL against DuckDB on the smallest tables; tape sources on small fixtures."""

import datetime as dt
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))

import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if v != v else f"{v:.6g}" if v else "0"
    return str(v)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_csv_tape(spark, tmp_path):
    from marlstone.sources.tape import load_tape

    (tmp_path / "t.csv").write_text('CUSIP,Execution Date/Time,Price,Quantity,Side,odd\nA,2024-01-02 10:00:00,99.5,5MM+,S,1\nB,2024-01-02 09:00:00,100,"$1,000",client sells,2\nC,2024-01-03 09:00:00,1,2K,Other,3\nD,2024-01-03 09:00:00,1,7,,4\n')
    rows = load_tape(spark, {"type": "csv", "path": str(tmp_path / "t.csv")}).collect()
    assert [(r.cusip, r.price, r.par_volume, r.side_flag, r.contra_party_type) for r in rows] == [
        ("B", 100.0, 1000.0, "1", "unknown"), ("A", 99.5, 5e6, "-1", "unknown"), ("C", 1.0, 2000.0, "other", "unknown"), ("D", 1.0, 7.0, "unknown", "unknown")
    ]
    assert rows[0].ts.hour == 9
    (tmp_path / "bad.csv").write_text("CUSIP,Price\nA,1\n")
    with pytest.raises(ValueError):
        load_tape(spark, {"type": "csv", "path": str(tmp_path / "bad.csv")})


def test_policies_and_sinks(spark, tmp_path):
    from marlstone.sources import policy, sinks, tape

    rows = spark.createDataFrame([("a", 1, 2.0, dt.datetime(2024, 1, 5)), ("a", -1, float("nan"), dt.datetime(2024, 2, 5)), (None, 5, None, None)], "id string, side int, price double, timestamp_utc timestamp")
    assert tuple(policy.structure(rows, key="id", sides="side", positive=["price"]).first()) == (3, 1, 1, 1, 2)
    for call in (lambda: policy.check_sides(rows), lambda: policy.require_columns(rows, ["x"]), lambda: policy.forbid_columns(rows, ["side"]), lambda: policy.public_only(rows.withColumn("latent_value", F.lit(1)))):
        with pytest.raises(ValueError):
            call()
    assert {r.column_name: (r.rows, r.nulls, r.n_distinct) for r in policy.profile(rows).collect()}["id"] == (3, 2 - 1, 1)
    sinks.write_monthly(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("year = 2024 AND month = 2").count() == 1
    sinks.write_bundle({"bonds": rows, "rfqs": None}, str(tmp_path / "b"))
    back = sinks.read_bundle(spark, str(tmp_path / "b"), ["bonds"], ["rfqs"])
    assert back["rfqs"] is None and tuple(sinks.digest(back["bonds"]).first()) == tuple(sinks.digest(rows.repartition(3)).first())
    assert sinks.stable_hash({"b": 1, "a": 2}) == sinks.stable_hash({"a": 2, "b": 1})
    sides = spark.createDataFrame([("client sells",), ("B",), ("odd",), (None,)], "s string")
    assert [r[0] for r in sides.select(tape.customer_side(F.col("s"))).collect()] == [-1, 1, None, None]
    assert [r[0] for r in sides.select(tape.tape_side(F.col("s"))).collect()] == ["1", "1", "odd", "unknown"]
    with pytest.raises(Exception):
        sides.select(tape.customer_side(F.col("s"), strict=True)).collect()
    asks = spark.createDataFrame([(1.0, "5", "FIRM", None), (-1.0, "x", None, "firm")], "side double, size string, stage string, request_type string")
    out = tape.normalise_requests(asks)
    assert [(r.notional, r.event_kind) for r in out.collect()] == [(5.0, "firm"), (None, "inquiry")]
    assert out.where(tape.firm_inquiry(out)).count() == 2 and tape.of_kind(out, "Firm").count() == 1
    assert tuple(tape.normalise_quotes(spark.createDataFrame([(1.0, 3.0)], "bid double, ask double")).first()) == (1.0, 3.0, 2.0, 2.0)
