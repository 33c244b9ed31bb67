"""Queries that write the events table in each format to the scratch folder and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.queries import add, table
from tidemill.sources import tables as so
from tidemill.streaming.bars import new_folder

SCHEMA = "sym string, event_id bigint, ts timestamp_ntz, price double"
SQL = "SELECT event_type AS sym, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS price FROM events"


def _ticks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("sym"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"))


def _seen(df: DataFrame) -> DataFrame:
    return df.select("sym", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("price", 6).alias("price"))


def _parquet(s: SparkSession, d: str) -> DataFrame:
    """Only the last days, of which the reader sees no other folders than theirs."""
    at = new_folder(s)
    so.write_parquet(_ticks(s, d), at)
    return _seen(so.read_parquet(s, at, SCHEMA + ", dt date").where("dt >= date'2024-01-20'"))


def _csv(s: SparkSession, d: str) -> DataFrame:
    at = new_folder(s)
    so.write_csv(_ticks(s, d), at)
    return _seen(so.read_csv(s, at, SCHEMA))


def _json(s: SparkSession, d: str) -> DataFrame:
    at = new_folder(s)
    so.write_json(_ticks(s, d), at)
    return _seen(so.read_jsonl(s, at, SCHEMA))


def _columnar(s: SparkSession, d: str) -> DataFrame:
    """One document a symbol and day: its columns as lists."""
    at = new_folder(s)
    lists = _ticks(s, d).groupBy("sym", F.to_date("ts").alias("dt")).agg(*[F.collect_list(F.col(c)).alias(c) for c in ("event_id", "ts", "price")])
    lists.select(F.transform("event_id", lambda _: F.col("sym")).alias("sym"), "event_id", "ts", "price").write.json(at)
    kinds = ", ".join(f"{c.split(' ')[0]} array<{c.split(' ')[1]}>" for c in SCHEMA.split(", "))
    return _seen(so.read_columnar_json(s, at, kinds, lines=True))


def _log(s: SparkSession, d: str) -> DataFrame:
    """Predictions logged in two calls, of which the second runs twice, compacted, and those of the last day read."""
    at = new_folder(s)
    ticks = _ticks(s, d)
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    for batch, part in (("early", early), ("late", ~early), ("late", ~early)):
        so.append_dated_log(ticks.where(part), at, batch)
    so.compact_log(s, at, SCHEMA)
    return _seen(so.read_dated_log(s, at, SCHEMA, period="week", now="2024-01-28 12:00:00"))


def _klines(s: SparkSession, d: str) -> DataFrame:
    """Ticks as exchange payloads of one bar each."""
    ms = (F.unix_millis(F.col("ts").cast("timestamp"))).cast("string")
    price = F.col("price").cast("string")
    fields = [ms, price, price, price, price, F.lit("1.0"), ms, *[F.lit("0")] * 5]
    payloads = _ticks(s, d).select("sym", "event_id", F.to_json(F.array(F.array(*fields))).alias("value"))
    return so.decode_klines(payloads).select("sym", "event_id", F.unix_millis(F.col("open_time").cast("timestamp")).alias("open_ms"), F.round("close", 6).alias("close"))


add("scan_parquet", _parquet, SQL + " WHERE ts >= TIMESTAMP '2024-01-20'")
add("scan_csv", _csv, SQL)
add("scan_jsonl", _json, SQL)
add("scan_columnar_json", _columnar, SQL)
add("prediction_log_week", _log, SQL + " WHERE ts >= TIMESTAMP '2024-01-22'")
add("decode_klines", _klines, "SELECT event_type AS sym, event_id, epoch_us(ts) // 1000 AS open_ms, round(value, 6) AS close FROM events")
