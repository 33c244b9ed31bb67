"""Trades on small frames whose entries, exits and equity are known."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.operators import backtest as bt
from tidemill.operators.learning import signal_multi_timeframe

T0 = dt.datetime(2023, 1, 1)
BARS = "sym string, ts timestamp, rn long, high double, low double, close double, atr double, signal string"
#: Highs, lows and closes of ten bars.
TEN = list(zip([101, 102, 103, 102, 104, 105, 106, 105, 107, 108], [99, 100, 101, 100, 102, 103, 104, 103, 105, 106], [101, 102, 101, 103, 104, 105, 104, 106, 107, 106], strict=True))


def frame(spark, rows, signals, atr=1.0, sym="a"):
    table = [(sym, T0 + dt.timedelta(minutes=k), k, float(h), float(low), float(c), atr, s) for k, ((h, low, c), s) in enumerate(zip(rows, signals, strict=True))]
    return spark.createDataFrame(table, BARS)


def trades(bars, sl, tp, slippage=0.0, equity=10000.0, risk=1.0, commission=0.0):
    outcomes = bt.cut(bt.barrier_outcome(bars, sl, tp, slippage))
    return bt.cut(bt.trade_log(bt.nonoverlap_trades(outcomes), equity, risk, commission))


def three(price, low=None, high=None):
    rows = [(price + 5, price - 5, price), (price + 15, price - 5, price), (price + 5, price - 15, price)]
    rows[1] = (rows[1][0] if high is None else high, rows[1][1] if low is None else low, price)
    return rows


def test_one_long_trade_wins(spark):
    rows = [*TEN[:2], (106, *TEN[2][1:]), *TEN[3:]]
    bars = frame(spark, rows, ["Flat", "Long", *["Flat"] * 8])
    log = trades(bars, 1.0, 2.0)
    (t,) = log.collect()
    assert (t.type, t.entry, t.exit, t.reason) == ("Long", 102, 104, "TP") and t.pnl > 0
    points = bt.equity_curve(log, bars, 10000.0).orderBy("bar_no").collect()
    assert [p.bar_no for p in points] == list(range(11)) and points[0].equity == points[2].equity == 10000 < points[-1].equity == t.equity


@pytest.mark.parametrize(
    ("signal", "rows", "sl", "tp", "slippage", "entry", "exit_", "reason"),
    [
        ("Long", three(100), 0.5, 1.0, 2.0, 102, 110, "TP"),
        ("Long", three(100, low=80), 1.0, 2.0, 3.0, 103, 90, "SL"),
        ("Short", three(200), 0.5, 1.0, 4.0, 196, 205, "SL"),
        ("Short", three(200, high=220), 1.0, 2.0, 5.0, 195, 210, "SL"),
        ("Long", three(100), 1.0, 1.0, 5.0, 105, 110, "TP"),
        ("Short", three(200), 1.0, 1.0, 7.0, 193, 210, "SL"),
    ],
)
def test_slippage_worsens_entry_and_exit(spark, signal, rows, sl, tp, slippage, entry, exit_, reason):
    (t,) = trades(frame(spark, rows, [signal, "Flat", "Flat"], 10.0), sl, tp, slippage).collect()
    assert (t.entry, t.exit, t.reason) == (entry, exit_, reason)


def test_no_equity_and_bankruptcy(spark):
    bars = frame(spark, TEN, ["Long"] * 10)
    assert {p.equity for p in bt.equity_curve(trades(bars, 1.0, 2.0, equity=0.0), bars, 0.0).collect()} == {0.0}
    curve = bt.equity_curve(trades(bars, 1.0, 2.0, equity=100.0, commission=1.0), bars, 100.0).collect()
    assert any(p.equity == 0 for p in curve) and min(p.equity for p in curve) == 0


def test_an_open_trade_ends_with_the_data(spark):
    bars = frame(spark, [(101, 99, 100)] * 4, ["Flat", "Long", "Flat", "Flat"], 50.0)
    assert [t.reason for t in trades(bars, 1.0, 1.0).collect()] == ["EndOfData"]


def test_costs_are_checked(spark):
    bars = frame(spark, TEN, ["Long"] * 10)
    for sl, tp in ((-1.0, 1.0), (1.0, 0.0)):
        with pytest.raises(ValueError, match="sl and tp"):
            bt.entry_levels(bars, sl, tp, 0.0)
    for risk, commission in ((2.0, 0.0), (0.5, -0.1)):
        with pytest.raises(ValueError, match="risk"):
            bt.trade_log(bars, 1.0, risk, commission)
    got = {r.sym: r.excessive for r in bt.slippage_sanity(bars.unionByName(frame(spark, [(1, 1, 1)] * 10, ["Flat"] * 10, sym="b")), 5.0).collect()}
    assert got == {"a": False, "b": True}


def test_signals_on_two_time_frames(spark):
    rows = [(0.8, 101.0, 95.0, 60.0, 98.0, 55.0), (0.5, 101.0, 95.0, 60.0, 98.0, 55.0), (0.8, 101.0, 95.0, 60.0, 98.0, 40.0), (0.8, 90.0, 95.0, 40.0, 92.0, 35.0), (0.8, 101.0, None, 60.0, 98.0, 55.0)]
    df = spark.createDataFrame(rows, "prob double, close double, `4h_ema_20` double, `4h_rsi_14` double, `1h_ema_20` double, `1h_rsi_14` double")
    assert [r.signal for r in signal_multi_timeframe(df, 0.7).collect()] == ["Long", "Flat", "Flat", "Short", "Flat"]
    assert {r.signal for r in signal_multi_timeframe(df.drop("4h_ema_20"), 0.7).collect()} == {"Flat"}


def test_a_search_finds_the_run_that_gains_most(spark):
    rows = [*TEN[:2], (106, *TEN[2][1:]), *TEN[3:]]
    bars = frame(spark, rows, ["Flat"] * 10).withColumn("prob", F.when(F.col("rn") == 1, 0.9).otherwise(0.1)).drop("signal")
    grid = spark.createDataFrame([(0, 1.0, 1.0, 0.5), (1, 1.0, 2.0, 0.5), (2, 1.0, 2.0, 0.95)], "run_id long, sl double, tp double, least double")
    found = bt.cut(bt.strategy_search(bars, grid, 0.0, 10000.0, 1.0, 0.0))
    got = {r.run_id: (r.sym, r.trades, round(r.final_equity, 6)) for r in found.collect()}
    assert got == {0: ("a", 1, round(10000 * (1 + 1 / 102), 6)), 1: ("a", 1, round(10000 * (1 + 2 / 102), 6)), 2: ("a", 0, 10000.0)}
    assert bt.best_run(found).first().run_id == 1


def test_trade_stats_without_wins_or_losses_equal_sql(spark, tmp_path):
    """Symbols with few bars, of which some only win and some only lose."""
    import duckdb

    from oracle import compare
    from tidemill.plans.catalog import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    c.execute(
        "CREATE TABLE events AS SELECT row_number() OVER (ORDER BY s, h) AS event_id, TIMESTAMP '2024-01-01 00:00:01' + h * INTERVAL 1 HOUR AS ts, 1::BIGINT AS user_id, "
        "repeat('x', s::INTEGER) AS event_type, (100 + (s * h * h * 7919) % 37)::DOUBLE AS value, '' AS props FROM range(1, 25) a(s), range(12) b(h)",
    )
    c.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = c.execute(ORACLE_SQL["perf_trade_stats"]).fetchall()
    assert {0.0, 1.0} < {r[2] for r in want} and all((r[3] is None) == (r[2] in (0.0, 1.0)) for r in want)
    compare(spark, str(tmp_path), QUERIES["perf_trade_stats"], ORACLE_SQL["perf_trade_stats"])


def test_a_long_row_of_losses_stays_whole(spark):
    """1,700 trades that each lose a fiftieth: equity falls under LEAST_EQUITY, which bounds the log only where it is meant to."""
    rows = spark.range(1700).select(
        F.lit("a").alias("sym"), "id", F.lit(T0).alias("ts"), F.col("id").alias("rn"), F.lit(1).alias("side"), F.lit(1.0).alias("entry"), F.lit(0.98).alias("stop"),
        F.lit(1.04).alias("target"), F.lit("SL").alias("reason"), F.lit(0.98).alias("exit"), (F.col("id") + 1).alias("exit_rn"),
    )
    assert bt.trade_stats(bt.trade_log(rows, 1000.0, 0.02, 0.0, least=0.0)).first().trades == 1700 > bt.trade_log(rows, 1000.0, 0.02, 0.0).count()


def test_a_stop_at_the_entry_is_no_error(spark):
    """An average range too small beside the price puts the stop at the entry: the size is then all that the equity buys."""
    bars = frame(spark, [(8, 8, 8), (9, 8, 9), (9, 9, 9)], ["Long", "Flat", "Flat"], 1e-17)
    (t,) = trades(bars, 1.0, 2.0, risk=0.02).collect()
    assert t.stop == t.entry == 8 and t["size"] == 10000 / 8
