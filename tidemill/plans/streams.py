"""Queries of streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.core import cut
from tidemill.plans.features import CTES, RECURSIVE
from tidemill.plans.quality import TS
from tidemill.plans.queries import BARS, _lr, add, bars, shown
from tidemill.streaming import stateful as st
from tidemill.streaming import live
from tidemill.streaming.bars import new_folder, run_available, stream_dedup, stream_ohlcv, tick_stream

add(
    "stream_ohlcv",
    lambda s, d: shown(run_available(stream_ohlcv(tick_stream(s, f"{d}/event[s].parquet"), "1 hour")), "open", "high", "low", "close", "volume"),
    # Bars whose end the watermark, the last tick less the delay, has passed.
    f"{BARS} SELECT sym, {TS}, {', '.join(f'round({c}, 6) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars "
    "WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
)


def _twice(s: SparkSession, d: str) -> DataFrame:
    """Every tick, and every third one again."""
    one = tick_stream(s, f"{d}/event[s].parquet")
    return one.unionByName(tick_stream(s, f"{d}/event[s].parquet").where("event_id % 3 = 0"))


add(
    "stream_dedup",
    lambda s, d: run_available(stream_dedup(_twice(s, d), ["event_id"], "60 days")).select("sym", "event_id", F.round("price", 6).alias("price")),
    "SELECT event_type AS sym, event_id, round(value, 6) AS price FROM events",
)


def _ticks(s: SparkSession, d: str) -> DataFrame:
    return tick_stream(s, f"{d}/event[s].parquet")


def _upserted(s: SparkSession, d: str) -> DataFrame:
    """The last event of each type and hour."""
    hours = _ticks(s, d).withColumn("loaded", F.col("event_id")).withColumn("ts", F.date_trunc("hour", "ts"))
    return s.read.parquet(st.stream_upsert(hours, new_folder(s))).select("sym", "ts", "event_id", "price")


def _matched(s: SparkSession, d: str) -> DataFrame:
    return _ticks(s, d).select(
        "ts", (F.col("price") > 10).cast("int").alias("prediction"),
        F.col("sym").isin("click", "view").cast("int").alias("actual"),
    )


add(
    "stream_upsert",
    lambda s, d: shown(_upserted(s, d), "event_id", "price"),
    "SELECT event_type AS sym, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, max(event_id) AS event_id, "
    "round(arg_max(value, event_id), 6) AS price FROM events GROUP BY event_type, date_trunc('hour', ts)",
)
add(
    "stream_prediction_log",
    lambda s, d: run_available(_ticks(s, d).select("event_id", "sym", (F.col("price") > 10).cast("int").alias("prediction"))),
    "SELECT event_id, event_type AS sym, (value > 10)::INTEGER AS prediction FROM events",
)
add(
    "stream_monitoring",
    lambda s, d: s.read.parquet(st.stream_monitoring(_matched(s, d), new_folder(s))).select("kind", "subject", F.round("value", 6).alias("value")),
    "SELECT 'accuracy' AS kind, strftime(date_trunc('day', ts), '%Y-%m-%d') AS subject, round(avg(((value > 10) = "
    "(event_type IN ('click', 'view')))::INTEGER), 6) AS value FROM events GROUP BY date_trunc('day', ts) HAVING "
    "avg(((value > 10) = (event_type IN ('click', 'view')))::INTEGER) < 0.7",
)


def _sides(s: SparkSession, d: str) -> DataFrame:
    """Ticks that come in two batches: first those from the 15th on, of which each tenth is missing, then the others."""
    at, folder = new_folder(s), new_folder(s)
    ticks = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))
    for k, part in enumerate(("day(ts) >= 15 and event_id % 10 <> 0", "day(ts) < 15 or event_id % 10 = 0")):
        ticks.where(part).write.parquet(f"{at}/{k}")
        rows, late = st.stream_late_rows(s.readStream.schema(ticks.schema).parquet(f"{at}/*"), folder)
    return s.read.parquet(rows).select("sym", "event_id", F.lit(False).alias("late")).union(s.read.parquet(late).select("sym", "event_id", F.lit(True)))


TWO = "WITH t AS (SELECT *, day(ts) < 15 OR event_id % 10 = 0 AS second FROM events)"
add(
    "stream_late_rows",
    _sides,
    f"{TWO} SELECT event_type AS sym, event_id, second AND ts < (SELECT max(ts) FROM t WHERE NOT second) - INTERVAL 1 "
    "HOUR AS late FROM t",
)
TICKS = "WITH t AS (SELECT event_type AS sym, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events)"


def _mean_sql(alpha: str, name: str) -> str:
    return f"{TICKS} SELECT sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round({_lr('value', alpha)}, 6) AS {name} FROM t"


add(
    "stream_ema",
    lambda s, d: shown(s.read.parquet(st.stream_ema(_ticks(s, d), new_folder(s), 20, "price")), "ema"),
    _mean_sql("(2.0::DOUBLE / 21)", "ema"),
)
add(
    "stream_wilder",
    lambda s, d: shown(s.read.parquet(st.stream_wilder(_ticks(s, d), new_folder(s), 14, ["price"])), "wilder_price"),
    _mean_sql("(1.0::DOUBLE / 14)", "wilder_price"),
)


def _live(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars that come in three runs of the query, each going on from the one before; every seventh bar of the day before a
    run's end comes with the next run."""
    at, folder = new_folder(s), new_folder(s)
    whole = cut(bars(s, d).select("sym", F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close"))
    day = F.day("ts")
    run = F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2) + F.when(day.isin(10, 20) & (F.hour("ts") % 7 == 0), 1).otherwise(0)
    for k in range(3):
        whole.where(run == k).write.parquet(f"{at}/{k}")
        live.run_live(s.readStream.schema(whole.schema).parquet(f"{at}/*"), folder, "2 days")
    return s.read.parquet(f"{folder}/rows")


LIVE = ("ema_20", "rsi_14", "atr_14", "psar")
add(
    "stream_indicators",
    lambda s, d: shown(_live(s, d), *LIVE),
    f"{RECURSIVE}, {CTES} SELECT sym, {TS}, {', '.join(f'round({c}, 6) AS {c}' for c in LIVE)} FROM whole WHERE ts <= (SELECT max(ts) FROM bars) - INTERVAL 2 DAY",
)


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    """Each tick is a prediction; two of three get their outcome, ten minutes later."""
    p = _ticks(s, d).select(F.col("event_id").alias("id"), "ts", (F.col("price") > 10).cast("int").alias("prediction"))
    o = _ticks(s, d).where("event_id % 3 > 0").select(F.col("event_id").alias("id"), (F.col("ts") + F.expr("interval 10 minutes")).alias("ts"), F.col("sym").isin("click", "view").cast("int").alias("actual"))
    return run_available(st.stream_outcome_join(p, o)).select("id", "prediction", "actual")


add(
    "stream_outcome_join",
    _outcomes,
    "WITH e AS (SELECT *, event_id % 3 > 0 AS known FROM events), w AS (SELECT least(max(ts), max(ts) FILTER (known) + INTERVAL 10 MINUTE) - INTERVAL 1 DAY AS mark FROM e) "
    "SELECT event_id AS id, (value > 10)::INTEGER AS prediction, CASE WHEN known THEN (event_type IN ('click', 'view'))::INTEGER END AS actual "
    "FROM e, w WHERE known OR ts + INTERVAL 1 DAY < mark",
)
