import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import backtest, cleaning, learning
from tidemill.plans.catalog import QUERIES
from tidemill.sources import tables


def test_klines(spark):
    row = [1672531200000, "1.5", "2", "1", "x", "10", 1672531259999, "15", 3, "1", "2", "0"]
    df = spark.createDataFrame([("a", json.dumps([row, row])), ("b", "no json"), ("c", None)], "sym string, value string")
    got = tables.decode_klines(df).collect()
    assert len(got) == 2 and got[0].sym == "a" and got[0].open == 1.5 and got[0].close is None and got[0].number_of_trades == 3
    assert str(got[0].open_time) == "2023-01-01 00:00:00" and got[0].close_time.microsecond == 999000


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-02 00:00:00", float("nan"))], "sym string, ts string, x double").withColumn("ts", F.col("ts").cast("timestamp"))
    tables.write_parquet(df, f"{tmp_path}/p")
    tables.write_parquet(df.where("x = 1").withColumn("x", F.lit(5.0)), f"{tmp_path}/p")
    assert sorted(str(r.x) for r in tables.read_parquet(spark, f"{tmp_path}/p").collect()) == ["5.0", "nan"]
    tables.write_csv(df, f"{tmp_path}/c")
    assert tables.read_csv(spark, f"{tmp_path}/c", "sym string, ts timestamp, x double").count() == 2
    tables.write_json(df, f"{tmp_path}/j")
    rows = tables.read_jsonl(spark, f"{tmp_path}/j", "sym string, ts timestamp, x double", since="2024-01-02").collect()
    assert len(rows) == 1 and rows[0].x is None
    tables.append_log(df, f"{tmp_path}/l", "first")
    tables.append_log(df, f"{tmp_path}/l", "second")
    assert spark.read.json(f"{tmp_path}/l").select("id").distinct().count() == 4
    (tmp_path / "k.json").write_text(json.dumps({"i": [1, 2], "p": [0.1, 0.2]}))
    assert tables.read_columnar_json(spark, f"{tmp_path}/k.json", "i array<int>, p array<double>").count() == 2
    (tmp_path / "u.json").write_text(json.dumps({"i": [1, 2], "p": [0.1]}))
    with pytest.raises(Exception, match="different lengths"):
        tables.read_columnar_json(spark, f"{tmp_path}/u.json", "i array<int>, p array<double>").count()


def test_stream_bars_equal_batch(spark):
    d = "/root/testdata/sf0.01"
    got = {tuple(r) for r in QUERIES["stream_ohlcv"](spark, d).collect()}
    want = {tuple(r) for r in QUERIES["resample_ohlcv"](spark, d).collect()}
    assert got <= want and len(want) - len(got) < 20


def test_empty_and_null_series(spark):
    empty = spark.createDataFrame([], "sym string, ts timestamp_ntz, rn long, close double, high double, low double, atr double, signal string")
    assert cleaning.fill(empty, ["close"]).count() == 0
    assert learning.split_time(empty).count() == 0
    assert backtest.nonoverlap_trades(backtest.barrier_outcome(empty, 1, 2, 0)).count() == 0
    nulls = spark.range(20).selectExpr("'a' sym", "id rn", "cast(null as double) x")
    assert cleaning.interpolate_linear(nulls, "x").where("x is not null").count() == 0
    assert cleaning.fill(nulls, ["x"]).count() == 20


def test_first_touch_over_levels(spark):
    """A tree of three levels against a plain search."""
    n = 5000
    bars = spark.range(n).select(F.lit("a").alias("sym"), F.col("id").alias("rn"), (F.col("id") * 7919 % 1009).cast("double").alias("high"), (-(F.col("id") * 104729 % 1013)).cast("double").alias("low"))
    entries = bars.where("rn % 37 = 5").select("sym", "rn", F.lit(1007.5).alias("up"), F.lit(-1011.5).alias("down"))
    got = {r.rn: r.hit for r in backtest.first_touch(entries, bars).collect()}
    touch = [i for i in range(n) if i * 7919 % 1009 >= 1007.5 or -(i * 104729 % 1013) <= -1011.5]
    want = {e: next((t for t in touch if t > e), None) for e in range(5, n, 37)}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_dated_log_prunes_and_compacts(spark, tmp_path):
    import os

    from tidemill.sources import tables as so

    at, schema = f"file://{tmp_path}/log", "id long, ts timestamp, x double"
    rows = spark.createDataFrame([(k, f"2024-01-{1 + k % 3:02d} 0{k % 8}:00:00", float(k)) for k in range(30)], "id long, ts string, x double").withColumn("ts", F.col("ts").cast("timestamp"))
    for batch, part in (("one", "id < 20"), ("two", "id >= 20"), ("two", "id >= 20")):  # the second call runs again
        so.append_dated_log(rows.where(part), at, batch)
    whole = sorted(tuple(r) for r in rows.collect())
    read = lambda: sorted(tuple(r) for r in so.read_dated_log(spark, at, schema).collect())
    assert read() == whole
    today = so.read_dated_log(spark, at, schema, "day", "2024-01-03 12:00:00")
    assert sorted(r.id for r in today.collect()) == [r[0] for r in whole if r[0] % 3 == 2]
    assert all("dt=2024-01-03" in f for f in today.inputFiles()) or "PartitionFilters: [isnotnull(dt" in today._jdf.queryExecution().toString()
    # A run that was cut short: the new batch is whole, one of the old ones is gone.
    day = f"{tmp_path}/log/dt=2024-01-01"
    spark.createDataFrame([("batch=one",), ("batch=two",)], "name string").coalesce(1).write.text(f"file://{day}/_replaced")
    spark.read.schema(schema).json([f"file://{day}/batch=one", f"file://{day}/batch=two"]).write.json(f"file://{day}/_new")
    for f in os.listdir(f"{day}/batch=one"):
        os.remove(f"{day}/batch=one/{f}")
    os.rmdir(f"{day}/batch=one")
    so.append_dated_log(rows.where("id = 0").withColumn("id", F.lit(900).cast("long")), at, "three")  # and one has come meanwhile
    so.compact_log(spark, at, schema, before="2024-01-03")
    later = sorted([*whole, (900, *whole[0][1:])])
    assert read() == later and sorted(os.listdir(day)) == ["batch=all", "batch=three"] and len(os.listdir(f"{tmp_path}/log/dt=2024-01-03")) == 2
    so.compact_log(spark, at, schema)
    so.compact_log(spark, at, schema)
    assert read() == later and os.listdir(day) == ["batch=all"]
    assert len([f for f in os.listdir(f"{day}/batch=all") if f.startswith("part")]) == 1
