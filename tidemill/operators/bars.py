"""Ticks to bars, and joins of bars of different lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ticks(events: DataFrame) -> DataFrame:
    """``sym, ts, event_id, price`` from the events table."""
    return events.select(F.col("event_type").alias("sym"), "ts", "event_id", F.col("value").alias("price"))


def resample_ohlcv(t: DataFrame, rule: str) -> DataFrame:
    """Bars of length ``rule``, left-closed and left-labelled: first, highest, lowest and last price and the number of
    ticks; empty bars don't come out. Order within a bar is by (ts, event_id)."""
    key = F.struct("ts", "event_id")
    g = t.groupBy("sym", F.window("ts", rule).alias("w"))
    b = g.agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return b.select("sym", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def enough_rows(b: DataFrame, least: int) -> DataFrame:
    """Bars of symbols that have ``least`` bars or more."""
    counts = b.groupBy("sym").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    return b.join(counts, "sym", "left_semi")


def asof_backward(left: DataFrame, right: DataFrame, columns: list[str], bucket: str = "day") -> DataFrame:
    """Each left row with the ``columns`` of the latest right row at or before its ``ts``.

    Both sides are cut into buckets of time. Within a bucket one ordered pass carries the last right row; what a bucket
    starts with is the last right row of the buckets before it, found over one summary row a bucket."""
    value = F.struct(*columns)
    a = left.select("sym", "ts", F.lit(1).alias("side"), F.struct(*left.columns).alias("l"), F.lit(None).alias("r"))
    b = right.select("sym", "ts", F.lit(0).alias("side"), F.lit(None).alias("l"), value.alias("r"))
    both = a.unionByName(b).withColumn("k", F.date_trunc(bucket, "ts").cast("string"))
    w = Window.partitionBy("sym", "k").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = both.where("side = 0").groupBy("sym", "k").agg(F.max_by("r", "ts").alias("e"))
    slots = both.select("sym", "k").distinct().join(last, ["sym", "k"], "left")
    before = Window.partitionBy("sym").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select("sym", "k", F.last("e", ignorenulls=True).over(before).alias("s"))
    filled = both.withColumn("v", F.last("r", ignorenulls=True).over(w)).where("side = 1").join(starts, ["sym", "k"])
    found = F.coalesce("v", "s")
    return filled.select("l.*", *[found[c].alias(c) for c in columns])
