"""Indicators of a stream of bars whose state is kept by symbol in Spark's state store."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidemill.operators import indicators as ind
from tidemill.operators.core import cut

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Live:
    """Which indicators: spans of exponential means, length of the Wilder means, accelerations of the Parabolic SAR."""

    spans: tuple[int, ...] = (20,)
    wilder: int = 14
    first: float = ind.ACCELERATION
    most: float = ind.MOST_ACCELERATION

    @property
    def state(self) -> str:
        """Columns of a symbol's state after its last bar: time in milliseconds, close, means (null before the second bar) and SAR."""
        means = [*[f"ema_{n}" for n in self.spans], "up", "down", "tr"]
        sar = [f"{c} {'boolean' if c == 'rising' else 'double'}" for c in ind.SAR_STATE]
        return ", ".join(["at bigint", "close double", *[f"{c} double" for c in means], *sar])

    @property
    def output(self) -> str:
        return ", ".join(["sym string", "at bigint", "close double", *[f"ema_{n} double" for n in self.spans], f"rsi_{self.wilder} double", f"atr_{self.wilder} double", "psar double"])

    def step(self, state: tuple | None, at: int, high: float, low: float, close: float) -> tuple:
        """The state after one more bar; the recurrences are those of ``operators.indicators``."""
        k = len(self.spans)
        if state is None:
            return (at, close, *[close] * k, None, None, None, *ind.sar_step(None, high, low, self.first, self.most))
        before, emas, (up, down, tr), sar = state[1], state[2 : 2 + k], state[2 + k : 5 + k], tuple(state[5 + k :])
        emas = [y + 2.0 / (n + 1) * (close - y) for n, y in zip(self.spans, emas, strict=True)]
        now = (max(close - before, 0.0), max(before - close, 0.0), max(high - low, abs(high - before), abs(low - before)))
        means = now if tr is None else [y + (x - y) / self.wilder for x, y in zip(now, (up, down, tr), strict=True)]
        return (at, close, *emas, *means, *ind.sar_step(sar, high, low, self.first, self.most))

    def shown(self, state: tuple) -> tuple:
        """The row of a bar from the state after it."""
        k = len(self.spans)
        up, down, tr = state[2 + k : 5 + k]
        rsi = None if tr is None else 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        rising, sar = state[5 + k : 7 + k]
        return (state[0], state[1], *state[2 : 2 + k], rsi, tr, sar if rising else None)


class _Processor(StatefulProcessor):
    """Holds bars until the watermark has passed them, then takes them in order of time.

    State of a symbol: ``now`` (after its last bar), ``waiting`` (bars ahead of the watermark) and ``due`` (the time of
    the one timer, that of the earliest waiting bar)."""

    def __init__(self, live: Live) -> None:
        self.live = live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", self.live.state)
        self.waiting = handle.getListState("waiting", "at bigint, high double, low double, close double")
        self.due = handle.getValueState("due", "at bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        columns = [c.split(" ")[0] for c in self.live.state.split(", ")]
        kinds = {"at": int, "rising": bool}
        self.now.update(tuple(None if pd.isna(row[c]) else kinds.get(c, float)(row[c]) for c in columns))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(*(pdf[c].tolist() for c in ("at", "high", "low", "close")), strict=True)]
        new = [r for r in new if not any(v is None or math.isnan(v) for v in r[1:])]
        if new:
            self.waiting.appendList([(int(r[0]), *map(float, r[1:])) for r in new])
            self._wake(min(r[0] for r in new))
        yield from self._taken(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.due.exists() and self.due.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.due.clear()
        yield from self._taken(key, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def _wake(self, at: int) -> None:
        if self.due.exists():
            if self.due.get()[0] <= at:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def _taken(self, key, until: int) -> Iterator[pd.DataFrame]:
        """Rows of the waiting bars up to ``until``; of bars with one time the last that came counts, and what is not after the
        symbol's last bar is left aside."""
        if self.due.exists() and self.due.get()[0] > until:
            return
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = {r[0]: r for r in held if r[0] <= until}
        if not ready:
            return
        rest = [tuple(r) for r in held if r[0] > until]
        self.waiting.clear()
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[0] for r in rest))
        state = tuple(self.now.get()) if self.now.exists() else None
        out = []
        for at in sorted(ready):
            if state is None or at > state[0]:
                state = self.live.step(state, *ready[at])
                out.append((key[0], *self.live.shown(state)))
        self.now.update(state)
        if out:
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in self.live.output.split(", ")])
            yield frame.astype({c: "float64" for c in frame.columns if c not in ("sym", "at")})

    def close(self) -> None:
        pass


def live_indicators(stream: DataFrame, late: str = "1 hour", live: Live = Live(), initial: DataFrame | None = None) -> DataFrame:
    """``sym, ts, close``, exponential means, RSI, ATR and Parabolic SAR of a stream of bars (``sym, ts, high, low, close``).

    A bar waits until the watermark (the latest time seen less ``late``) has passed it and is then taken in order of time,
    so bars may come out of order by up to ``late``; later ones are dropped and counted by Spark. Bars without prices are left
    out; times count in milliseconds. State is one row a symbol and its waiting bars, in the state store; a symbol goes on from ``initial``
    (:func:`states_of` of a batch) where that has it, and bars that are not after it fall away. Rows of a symbol are taken by
    one task of a batch, since each depends on the one before."""
    bars = stream.select("sym", "ts", F.unix_millis(F.col("ts").cast("timestamp_ltz")).alias("at"), *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")]).withWatermark("ts", late)
    start = None if initial is None else initial.groupBy("sym")
    found = bars.groupBy("sym").transformWithStateInPandas(_Processor(live), live.output, "Append", "EventTime", start)
    return found.select("sym", F.timestamp_millis("at").alias("ts"), *found.columns[2:])


def states_of(bars: DataFrame, live: Live = Live()) -> DataFrame:
    """``sym`` and the state after each symbol's last bar, from the batch operators: where :func:`live_indicators` goes on."""
    rows = cut(ind.positions(bars))
    emas = ind.emas(rows, live.spans).groupBy("sym").agg(
        F.max_by(F.unix_millis(F.col("ts").cast("timestamp_ltz")), "rn").alias("at"), F.max_by("close", "rn").alias("close"),
        *[F.max_by(f"ema_{n}", "rn").alias(f"ema_{n}") for n in live.spans],
    )
    moves = ind.wilder(ind._moves(rows), {"__up": ("rise", live.wilder), "__down": ("fall", live.wilder), "__tr": ("tr", live.wilder)})
    means = moves.groupBy("sym").agg(*[F.max_by(f"__{c}", "rn").alias(c) for c in ("up", "down", "tr")])
    states, _ = ind.sar_states(rows, live.first, live.most)
    sar = states.groupBy("sym").agg(*[F.max_by(f"out_{c}", "b").alias(c) for c in ind.SAR_STATE])
    columns = [c.split(" ")[0] for c in live.state.split(", ")]
    return cut(emas.join(means, "sym", "left").join(sar, "sym").select("sym", *columns))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, outside of the executors' heap; this is what state by key asks for."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run_live(stream: DataFrame, folder: str, late: str = "1 hour", live: Live = Live(), initial: DataFrame | None = None) -> StreamingQuery:
    """Runs what there is of a stream of bars into ``folder/rows``, going on from the checkpoint under ``folder``; returns the ended query."""
    with rocksdb(stream.sparkSession):
        out = live_indicators(stream, late, live, initial).writeStream.format("parquet").outputMode("append")
        query = out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return query
