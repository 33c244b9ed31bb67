import pytest
from oracle import compare

from tidemill.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    compare(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLE_SQL[name])


def test_chunks_equal_whole(spark):
    from tidemill.operators.core import chunk_windows, recurrence
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.lit("a").alias("sym"), F.col("id").alias("rn"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    build = lambda b, over: b.withColumn("m", F.avg("x").over(over(-9, 3)))
    small, large = (chunk_windows(rows, 9, 3, build, n).orderBy("rn").toPandas() for n in (17, 5000))
    assert (small.m - large.m).abs().max() < 1e-12
    y = recurrence(rows, "x", "y", 0.1, block=16).orderBy("rn").toPandas()
    assert (y.y - y.x.ewm(alpha=0.1, adjust=False).mean()).abs().max() < 1e-9


def test_dense_ticks_are_ordered_in_even_ranges(spark):
    """Most ticks lie in one second of one day, in microseconds of their own; others are spread over months."""
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F
    from tidemill.operators.core import even_position, even_ranges

    day = datetime(2024, 2, 28, 23, 59, 59)
    times = [day + timedelta(microseconds=40 * i * i % 999_983) for i in range(3000)] + [day + timedelta(hours=7 * i - 3000) for i in range(900)]
    rows = [("a", t, 1.0) for t in {*times}] + [("b", t, 2.0) for t in {*times[:50], *times[-50:]}] + [("c", day, 3.0), ("c", None, 4.0), (None, day, 5.0)]
    ticks = spark.createDataFrame(rows, "sym string, ts timestamp, x double").repartition(5)
    placed = sorted(r for r in rows if r[0] and r[1])
    want, seen = [], {}
    for r in placed:
        want.append((*r, seen.setdefault(r[0], 0)))
        seen[r[0]] += 1
    for limit in (64, 4096):
        assert sorted(map(tuple, even_position(ticks.withColumn("ts", F.col("ts").cast("timestamp_ntz")), limit).select("sym", "ts", "x", "rn").collect())) == want
        assert sorted(map(tuple, even_position(ticks, limit).select("sym", "ts", "x", "rn").collect())) == want
    sizes = [r["count"] for r in even_ranges(ticks, 64).groupBy("sym", "__range").count().collect()]
    assert max(sizes) <= 128 and len(sizes) > 40
    assert even_position(ticks.where(F.lit(False)), 64).count() == 0


def test_walk_forward_folds_cover_the_series(spark):
    from tidemill.plans import training

    d = "/root/testdata/sf0.001"
    n = {r.sym: r.n for r in training._rows(spark, d).groupBy("sym").agg({"*": "count"}).toDF("sym", "n").collect()}
    folds = training._folds(spark, d).collect()
    for sym in n:
        mine = sorted((f.test_start, f.test_end, f.train_start, f.train_end) for f in folds if f.sym == sym)
        assert mine[-1][1] == n[sym] and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
        assert all(f[2] == 0 and f[3] == f[0] for f in mine) and mine[0][0] == n[sym] // (training.FOLDS + 1)


def test_epoch_milliseconds_beyond_year_9999(spark, tmp_path):
    """Years of five and six digits, years before 1, and milliseconds that doubles of seconds would lose."""
    import duckdb

    keys = "(0), (-1), (NULL), (2932892), (2932893), (8999999), (13000001), (106751000), (-719200), (-720000), (-106000000)"
    duckdb.connect().execute(f"COPY (SELECT k::BIGINT AS o_orderkey FROM (VALUES {keys}) t(k)) TO '{tmp_path}/orders.parquet'")
    compare(spark, str(tmp_path), QUERIES["epoch_ms_to_ts"], ORACLE_SQL["epoch_ms_to_ts"])


def test_filling_looks_ahead_in_growing_frames(spark):
    """Both sides of a fill equal pandas' over many chunks and over one, and no frame is summed anew for each row."""
    from pyspark.sql import functions as F
    from tidemill.operators.cleaning import fill
    from tidemill.operators.core import carry, carry_sides

    x = F.when((F.col("id") * 7919 % 101 < 9) & F.col("id").between(300, 19000), F.col("id").cast("double"))
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("sym"), F.floor(F.col("id") / 3).alias("k"), "id", x.alias("x"))
    rows = rows.withColumn("rn", F.when(F.col("sym") == "a", F.col("k")).otherwise(2 * F.col("k") + F.col("id") % 3 - 1)).drop("k")
    rows = rows.unionByName(rows.limit(50).withColumns({"sym": F.lit("none"), "x": F.lit(None).cast("double"), "rn": F.col("id")}))
    want = rows.toPandas().sort_values(["sym", "rn"]).reset_index(drop=True)
    by = want.groupby("sym").x
    for chunk in (7, 4096, 10**6):
        got = carry_sides(rows, ["x"], {"f": False, "n": True}, chunk).toPandas().sort_values(["sym", "rn"]).reset_index(drop=True)
        assert got.xf.equals(by.ffill()) and got.xn.equals(by.bfill()) and got.id.equals(want.id)
    for filled in (fill(rows, ["x"]), carry(rows, ["x"], "_n", ahead=True)):
        assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower()
