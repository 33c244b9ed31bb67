"""Registered queries over the given tables, each with the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import indicators as ind
from tidemill.operators import metrics
from tidemill.operators.bars import asof_backward, enough_rows, resample_ohlcv, ticks
from tidemill.operators.cleaning import keep_one
from tidemill.operators.core import row_position

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def _bars_sql(name: str, rule: str) -> str:
    return f"""{name} AS (SELECT event_type AS sym, time_bucket(INTERVAL {rule}, ts) AS b, arg_min(value, (ts, event_id)) AS open,
    max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""


BARS = f"WITH {_bars_sql('raw', '1 HOUR')}, bars AS (SELECT * RENAME (b AS ts), row_number() OVER (PARTITION BY sym ORDER BY b) - 1 AS rn FROM raw)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, rule: str = "1 hour") -> DataFrame:
    return resample_ohlcv(ticks(table(spark, sf_dir, "events")), rule)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """``sym``, ``ts`` as text, and columns with doubles rounded."""
    kinds = dict(df.dtypes)
    out = [F.round(c, DIGITS).alias(c) if kinds[c] == "double" else F.col(c) for c in columns]
    return df.select("sym", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *out)


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def indicator(name: str, columns: dict[str, str], more: str = "") -> None:
    """A query of finite indicators: column names and their SQL over ``bars`` or the table ``x`` of ``more``."""
    sql = ", ".join(f"{e} AS {c}" if "fractal" in c else f"round({e}, {DIGITS}) AS {c}" for c, e in columns.items())
    add(
        name,
        lambda s, d: shown(ind.finite_indicators(bars(s, d)), *columns),
        f"{BARS}{more} SELECT sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {sql} FROM {'x' if more else 'bars'}",
    )


def _w(n: int, ahead: int = 0) -> str:
    return f"OVER (PARTITION BY sym ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND {f'{ahead} FOLLOWING' if ahead else 'CURRENT ROW'})"


def _full(e: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {_w(n)} = {n} THEN {e} END"


def _sma(c: str, n: int) -> str:
    return _full(f"avg({c}) {_w(n)}", c, n)


LAG = "lag(close) OVER (PARTITION BY sym ORDER BY rn)"
TR = f"CASE WHEN {LAG} IS NOT NULL THEN greatest(high - low, abs(high - {LAG}), abs(low - {LAG})) END"
X_TR = f", x AS (SELECT *, {TR} AS tr FROM bars)"
X_DIFF = f", x AS (SELECT *, coalesce(greatest(close - {LAG}, 0), 0) AS rise, coalesce(greatest({LAG} - close, 0), 0) AS fall FROM bars)"
RANGE = f"(max(high) {_w(14)} - min(low) {_w(14)})"
FAST = _full(f"100 * (close - min(low) {_w(14)}) / nullif({RANGE}, 0)", "close", 14)
X_K = f", y AS (SELECT *, {FAST} AS k FROM bars), x AS (SELECT *, {_sma('k', 3)} AS k3 FROM y)"
X_CCI = f", y AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), x AS (SELECT *, avg(tp) {_w(20)} AS m, list(tp) {_w(20)} AS tps FROM y)"

indicator("sma", {f"sma_{n}": _sma("close", n) for n in (10, 20, 50)})
indicator(
    "bbands_pop",
    {"bb_upper": _full(f"avg(close) {_w(20)} + 2 * stddev_pop(close) {_w(20)}", "close", 20), "bb_lower": _full(f"avg(close) {_w(20)} - 2 * stddev_pop(close) {_w(20)}", "close", 20)},
)
indicator("bbands_sample", {"bb_mid": f"avg(close) {_w(20)}", "bb_sd": f"stddev_samp(close) {_w(20)}"})
indicator("rsi_sma", {"rsi_sma": f"100 - 100 / (1 + avg(rise) {_w(14)} / (avg(fall) {_w(14)} + 1e-9))"}, X_DIFF)
indicator("stoch", {"stoch_k": "k3", "stoch_d": _sma("k3", 3)}, X_K)
indicator("willr", {"willr_14": _full(f"-100 * (max(high) {_w(14)} - close) / nullif({RANGE}, 0)", "close", 14)})
indicator(
    "cci",
    {"cci_20": "CASE WHEN len(tps) = 20 THEN (tp - m) / nullif(0.015 * list_sum(list_transform(tps, lambda v: abs(v - m))) / 20, 0) END"},
    X_CCI,
)
indicator("roc", {f"roc_{n}": f"100 * (close / nullif(lag(close, {n}) OVER (PARTITION BY sym ORDER BY rn), 0) - 1)" for n in (1, 5, 15)})
indicator("true_range", {"true_range": "tr"}, X_TR)
indicator("atr_sma", {"atr_sma": _sma("tr", 14)}, X_TR)
indicator("diff", {"diff": f"close - {LAG}"})
indicator("volume_osc", {"volume_osc": f"{_sma('volume', 14)} - {_sma('volume', 28)}"})
indicator(
    "fractals",
    {"fractal_high": f"CASE WHEN count(*) {_w(3, 2)} = 5 AND high = max(high) {_w(3, 2)} THEN 1 ELSE 0 END::INTEGER", "fractal_low": f"CASE WHEN count(*) {_w(3, 2)} = 5 AND low = min(low) {_w(3, 2)} THEN 1 ELSE 0 END::INTEGER"},
)
X_ATR = (
    f"{X_TR.replace('x AS', 'z AS')}, y AS (SELECT *, {_sma('tr', 14)} AS atr FROM z), x AS (SELECT *, "
    f"{_full(f'median(atr) {_w(28)}', 'atr', 28)} AS med FROM y)"
)
add(
    "rolling_median",
    lambda s, d: shown(ind.finite_indicators(bars(s, d)), "atr_median"),
    f"{BARS}{X_ATR} SELECT sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(med, 6) AS atr_median FROM x",
)
add(
    "regime_volatility",
    lambda s, d: shown(ind.regime_volatility(ind.finite_indicators(bars(s, d))), "regime"),
    f"{BARS}{X_ATR} SELECT sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN atr > 1.5 * med THEN 'volatile' ELSE "
    "'normal' END AS regime FROM x",
)


def _lr(c: str, alpha: str) -> str:
    return f"list_reduce(list({c}) OVER (PARTITION BY sym ORDER BY rn), lambda a, v: a * (1 - {alpha}) + v * {alpha})"


add(
    "ema",
    lambda s, d: shown(ind.emas(bars(s, d), (9, 50)), "ema_9", "ema_50"),
    f"{BARS} SELECT sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round({_lr('close', '(2.0::DOUBLE / 10)')}, 6) AS "
    f"ema_9, round({_lr('close', '(2.0::DOUBLE / 51)')}, 6) AS ema_50 FROM bars",
)
add(
    "macd",
    lambda s, d: shown(ind.macd(bars(s, d)), "macd", "macd_signal"),
    f"{BARS}, y AS (SELECT *, {_lr('close', '(2.0::DOUBLE / 13)')} - {_lr('close', '(2.0::DOUBLE / 27)')} AS m FROM bars) "
    f"SELECT sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(m, 6) AS macd, round({_lr('m', '0.2::DOUBLE')}, 6) AS "
    "macd_signal FROM y",
)
add(
    "resample_ohlcv",
    lambda s, d: shown(bars(s, d), "open", "high", "low", "close", "volume"),
    f"{BARS} SELECT sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, "
    f"{', '.join(f'round({c}, 6) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars",
)
add(
    "htf_min_rows",
    lambda s, d: shown(enough_rows(bars(s, d, "1 day"), 20), "close"),
    f"WITH {_bars_sql('raw', '1 DAY')} SELECT sym, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, round(close, 6) AS close FROM "
    "raw QUALIFY count(*) OVER (PARTITION BY sym) >= 20",
)
add(
    "row_position",
    lambda s, d: shown(row_position(bars(s, d)), "rn"),
    f"{BARS} SELECT sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, rn FROM bars",
)


def _asof(s: SparkSession, d: str) -> DataFrame:
    right = bars(s, d, "4 hours").select("sym", "ts", F.col("close").alias("h4_close"))
    return shown(asof_backward(bars(s, d).select("sym", "ts", "close"), right, ["h4_close"]), "close", "h4_close")


add(
    "asof_backward",
    _asof,
    f"{BARS}, {_bars_sql('h4', '4 HOURS')} SELECT bars.sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(bars.close, 6) "
    "AS close, round(h4.close, 6) AS h4_close FROM bars ASOF LEFT JOIN h4 ON bars.sym = h4.sym AND bars.ts >= h4.b",
)
SCORED = "WITH m AS (SELECT quality AS y, (n_chars >= 1000)::INTEGER AS p, n_chars AS s FROM labels JOIN documents USING (doc_id))"


def _scored(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", F.col("n_chars").alias("s"), (F.col("n_chars") >= 1000).cast("int").alias("p"))
    return table(s, d, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


add(
    "classification_metrics",
    lambda s, d: _rounded(metrics.classification_metrics(_scored(s, d), "y", "p")),
    SCORED + ", c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = p) AS ok, count(*) AS n FROM m) SELECT round(ok / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c",
)
add(
    "roc_auc",
    lambda s, d: _rounded(metrics.roc_auc(_scored(s, d), "y", "s")),
    SCORED + ", h AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM m GROUP BY s), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM h) SELECT round((sum(p * (b + n / 2)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auc FROM c",
)
add(
    "missing_report",
    lambda s, d: _rounded(metrics.missing_report(table(s, d, "events"), ["ts", "value", "user_id"])),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, round(1 - count(*) FILTER ({c} IS NULL) / count(*), 6) AS completeness FROM events" for c in ("ts", "value", "user_id")),
)
add(
    "value_counts",
    lambda s, d: _rounded(metrics.value_counts(table(s, d, "events"), "event_type")),
    "SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events "
    "GROUP BY 1",
)


def _curve(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return o.groupBy(F.lit("all").alias("sym"), F.col("o_orderdate").alias("ts")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("equity"))


CURVE = (
    "WITH c AS (SELECT o_orderdate AS ts, sum(o_totalprice::DOUBLE) AS equity FROM orders GROUP BY 1), r AS (SELECT *, "
    "equity / lag(equity) OVER (ORDER BY ts) - 1 AS r, max(equity) OVER (ORDER BY ts) AS top FROM c)"
)
add(
    "equity_metrics",
    lambda s, d: _rounded(metrics.equity_metrics(_curve(s, d), risk_free=0.02)),
    CURVE + " SELECT 'all' AS sym, round((avg(r) - 0.02 / 252) / stddev_pop(r) * sqrt(252), 6) AS sharpe, round((avg(r) - 0.02 / 252) / (stddev_pop(r) FILTER (r < 0)) * sqrt(252), 6) AS sortino, round(pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / count(*)) - 1, 6) AS cagr, round(arg_max(equity, ts) / arg_min(equity, ts) - 1, 6) AS total_return, round(min((equity - top) / top), 6) AS max_drawdown FROM r",
)
add(
    "drawdown_curve",
    lambda s, d: metrics.curve_steps(_curve(s, d)).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.round("drawdown", DIGITS).alias("drawdown")),
    CURVE + " SELECT strftime(ts, '%Y-%m-%d') AS day, round((equity - top) / top, 6) AS drawdown FROM r",
)
add(
    "dedup_keep_last",
    lambda s, d: keep_one(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], last=True).select("user_id", "event_type", "event_id", "value"),
    "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value "
    "FROM events GROUP BY 1, 2",
)
add(
    "date_range_filter",
    lambda s, d: table(s, d, "events").where("ts >= timestamp_ntz'2024-01-05 00:00:00' and ts < timestamp_ntz'2024-01-08 00:00:00'").select("event_id", "value"),
    "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'",
)
add(
    "signal_threshold",
    lambda s, d: shown(bars(s, d).withColumn("prob", F.pmod(F.expr("hour(ts) * 7919 + day(ts) * 104729 + length(sym)"), F.lit(1000)) / 1000).withColumn("signal", F.when(F.col("prob") > 0.55, "Long").otherwise("Flat")), "signal"),
    f"{BARS} SELECT sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN ((hour(ts) * 7919 + day(ts) * 104729 + "
    "length(sym)) % 1000) / 1000 > 0.55 THEN 'Long' ELSE 'Flat' END AS signal FROM bars",
)
