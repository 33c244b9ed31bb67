"""Technical indicators with finite frames, as one pass over halo chunks, and recurrences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.core import chunk_windows, cut, full, lagged, recurrence, recurrences, row_position, running


def sma(c: str, n: int, over) -> Column:
    return full(F.avg(c).over(over(1 - n, 0)), F.count(c).over(over(1 - n, 0)), n)


def finite_indicators(bars: DataFrame) -> DataFrame:
    """All indicators with a finite look-back at once: ``sym, ts, rn`` and bars' columns with moving averages, Bollinger
    bands (population and sample), RSI by plain means, stochastic, CCI, Williams %R, rate of change, true range and its
    mean, volume oscillator and fractals. Values whose frame isn't full are null where the definition asks for it."""

    def build(b: DataFrame, over) -> DataFrame:
        # Columns come in few steps, each on the columns of the ones before, as Spark analyses the whole plan at every step.
        w14, w20, five = over(-13, 0), over(-19, 0), over(-2, 2)
        top, low = F.max("high").over(w14), F.min("low").over(w14)
        is14, is20 = F.count("close").over(w14), F.count("close").over(w20)
        whole = F.count("close").over(five) == 5
        first = {
            "prev": F.max("close").over(over(-1, -1)),
            "tp": (F.col("high") + F.col("low") + F.col("close")) / 3,
            "bb_std": full(F.stddev_pop("close").over(w20), is20, 20),
            "bb_mid": F.avg("close").over(w20),
            "bb_sd": F.stddev_samp("close").over(w20),
            "bb_width": F.try_divide(4 * F.when(is20 == 20, F.stddev_samp("close").over(w20)), "close"),
            "fast_k": full(F.try_divide(100 * (F.col("close") - low), top - low), is14, 14),
            "willr_14": full(F.try_divide(-100 * (top - F.col("close")), top - low), is14, 14),
            "volume_osc": sma("volume", 14, over) - sma("volume", 28, over),
            "fractal_high": F.when(whole & (F.col("high") == F.max("high").over(five)), 1).otherwise(0),
            "fractal_low": F.when(whole & (F.col("low") == F.min("low").over(five)), 1).otherwise(0),
        }
        first |= {f"sma_{n}": sma("close", n, over) for n in (10, 20, 50)}
        first |= {f"roc_{n}": 100 * (F.try_divide(F.col("close"), F.max("close").over(over(-n, -n))) - 1) for n in (1, 5, 15)}
        b = b.withColumns(first)
        diff, high_low = F.col("close") - F.col("prev"), F.col("high") - F.col("low")
        tr = F.when(F.col("prev").isNotNull(), F.greatest(high_low, F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev"))))
        b = b.withColumns({
            "diff": diff, "true_range": tr,
            "rise": F.greatest(F.coalesce(diff, F.lit(0.0)), F.lit(0.0)), "fall": F.greatest(-F.coalesce(diff, F.lit(0.0)), F.lit(0.0)),
            "bb_upper": F.col("sma_20") + 2 * F.col("bb_std"), "bb_lower": F.col("sma_20") - 2 * F.col("bb_std"),
            "stoch_k": sma("fast_k", 3, over),
            "tps": F.collect_list("tp").over(w20), "tp_mean": F.avg("tp").over(w20),
            "bb_width_median": full(F.expr("percentile(bb_width, 0.5)").over(over(-39, 0)), F.count("bb_width").over(over(-39, 0)), 40),
        })
        mad = F.aggregate("tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("tp_mean"))) / 20
        b = b.withColumns({
            "rsi_sma": 100 - 100 / (1 + F.avg("rise").over(w14) / (F.avg("fall").over(w14) + 1e-9)),
            "stoch_d": sma("stoch_k", 3, over), "atr_sma": sma("true_range", 14, over),
            "cci_20": full(F.try_divide(F.col("tp") - F.col("tp_mean"), 0.015 * mad), F.size("tps"), 20),
        })
        median = full(F.expr("percentile(atr_sma, 0.5)").over(over(-27, 0)), F.count("atr_sma").over(over(-27, 0)), 28)
        return b.withColumn("atr_median", median).drop("tps", "tp_mean", "rise", "fall", "prev")

    return chunk_windows(positions(bars), 64, 2, build)


def positions(bars: DataFrame) -> DataFrame:
    return bars if "rn" in bars.columns else row_position(bars)


def emas(bars: DataFrame, spans: Iterable[int], column: str = "close") -> DataFrame:
    """Adds ``ema_<n>`` for each span: exponential means, begun with the first value, all in one pass."""
    return recurrences(positions(bars), {f"ema_{n}": (column, 2.0 / (n + 1)) for n in spans})


def ema(bars: DataFrame, n: int, column: str = "close", out: str | None = None) -> DataFrame:
    """Exponential mean of span ``n``, begun with the first value."""
    return recurrence(positions(bars), column, out or f"ema_{n}", 2.0 / (n + 1))


def macd(bars: DataFrame, spans: Iterable[int] = ()) -> DataFrame:
    """Difference of the 12 and 26 bar means, its 9 bar signal and their difference; means of other spans come along."""
    b = emas(bars, dict.fromkeys([12, 26, *spans])).withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    return recurrence(b, "macd", "macd_signal", 0.2).withColumn("macd_diff", F.col("macd") - F.col("macd_signal"))


def regime_volatility(indicators: DataFrame) -> DataFrame:
    """``volatile`` where the mean true range is over 1.5 times its median over 28 bars, else ``normal``."""
    return indicators.withColumn("regime", F.when(F.col("atr_sma") > 1.5 * F.col("atr_median"), "volatile").otherwise("normal"))


def wilder(df: DataFrame, means: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds Wilder means (name: source and n, the weight is 1/n) from a symbol's second row on, all in one pass; its first
    row falls away."""
    later = df.where("rn >= 1").withColumn("rn", F.col("rn") - 1)
    return recurrences(later, {out: (x, 1.0 / n) for out, (x, n) in means.items()}).withColumn("rn", F.col("rn") + 1)


MOVES = ("rise", "fall", "plus_dm", "minus_dm", "tr")


def _moves(bars: DataFrame) -> DataFrame:
    b = lagged(positions(bars), ["close", "high", "low"])
    diff, up, down = F.col("close") - F.col("close_prev"), F.col("high") - F.col("high_prev"), F.col("low_prev") - F.col("low")
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("close_prev")), F.abs(F.col("low") - F.col("close_prev")))
    moves = {
        "rise": F.greatest(diff, F.lit(0.0)),
        "fall": F.greatest(-diff, F.lit(0.0)),
        "plus_dm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "minus_dm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "tr": true_range,
    }
    return b.withColumns(moves).drop("close_prev", "high_prev", "low_prev")


def _rsi(w: DataFrame, n: int) -> DataFrame:
    value = F.when(F.col(f"__down{n}") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(f"__up{n}", f"__down{n}")))
    return w.withColumn(f"rsi_{n}", value).drop(f"__up{n}", f"__down{n}")


def _rsi_means(n: int) -> dict[str, tuple[str, int]]:
    return {f"__up{n}": ("rise", n), f"__down{n}": ("fall", n)}


def rsi_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds ``rsi_<n>`` by Wilder means of gains and losses, from the second row on; 100 where nothing fell."""
    return _rsi(wilder(_moves(bars), _rsi_means(n)), n).drop(*MOVES)


def atr_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds ``atr_<n>``, the Wilder mean of the true range, from the second row on."""
    return wilder(_moves(bars), {f"atr_{n}": ("tr", n)}).drop(*MOVES)


def _dx(w: DataFrame) -> DataFrame:
    w = w.withColumn("di_plus", F.try_divide(100 * F.col("__p"), F.col("__t"))).withColumn("di_minus", F.try_divide(100 * F.col("__m"), F.col("__t")))
    dx = F.try_divide(100 * F.abs(F.col("__p") - F.col("__m")), F.col("__p") + F.col("__m"))
    return w.withColumn("__dx", F.coalesce(dx, F.lit(0.0))).drop("__p", "__m", "__t")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds ``di_plus``, ``di_minus`` and ``adx`` from the second row on; without any movement DX counts as 0."""
    w = _dx(wilder(_moves(bars), {"__p": ("plus_dm", n), "__m": ("minus_dm", n), "__t": ("tr", n)}))
    return wilder(w, {"adx": ("__dx", n)}).drop("__dx", *MOVES)


def wilder_set(bars: DataFrame, rsi: Iterable[int] = (2, 7, 14), n: int = 14) -> DataFrame:
    """The Wilder indicators together: ``rsi_<k>`` of each k, ``atr_<n>``, ``di_plus``, ``di_minus`` and ``adx``, in two
    passes for all."""
    means = {"__p": ("plus_dm", n), "__m": ("minus_dm", n), "__t": ("tr", n), f"atr_{n}": ("tr", n)}
    for k in rsi:
        means |= _rsi_means(k)
    w = wilder(_moves(bars), means)
    for k in rsi:
        w = _rsi(w, k)
    return wilder(_dx(w), {"adx": ("__dx", n)}).drop("__dx", *MOVES)


#: Acceleration of a Parabolic SAR: at the start of a trend and for each new extreme, and at most.
ACCELERATION, MOST_ACCELERATION = 0.02, 0.2
#: Rows of a block of a Parabolic SAR, and rows before it from which its first guess of a state starts.
SAR_BLOCK, SAR_LEAD = 2048, 256
#: State of a Parabolic SAR after a bar: the trend, the SAR, the extreme of the trend, the acceleration, and the last
#: two bars' highs and lows.
SAR_STATE = ("rising", "sar", "extreme", "speed", "high1", "low1", "high2", "low2")


def sar_step(state: tuple | None, high: float, low: float, first: float, most: float) -> tuple:
    """The state after one more bar. The SAR moves towards the trend's extreme and stays outside of the two bars before; a
    bar beyond it turns the trend, whose SAR begins at the extreme of the one that ended. Trends begin rising."""
    if state is None:
        return True, low, high, first, high, low, high, low
    rising, sar, extreme, speed, high1, low1, high2, low2 = state
    sar += speed * (extreme - sar)
    if rising:
        sar, turned = min(sar, low1, low2), low < min(sar, low1, low2)
    else:
        sar, turned = max(sar, high1, high2), high > max(sar, high1, high2)
    if turned:
        rising, sar, speed = not rising, extreme, first
        extreme = high if rising else low
    elif high > extreme if rising else low < extreme:
        extreme, speed = (high if rising else low), min(speed + first, most)
    return rising, sar, extreme, speed, high, low, high1, low1


def _sar_fields(prefix: str) -> str:
    return ", ".join(f"{prefix}{c} {'boolean' if c == 'rising' else 'double'}" for c in SAR_STATE)


def _sar_begin(row: pd.Series, prefix: str) -> tuple | None:
    one = tuple(row[prefix + c] for c in SAR_STATE)
    return None if pd.isna(one[1]) else (bool(one[0]), *map(float, one[1:]))


def _sar_same(a: tuple | None, b: tuple | None) -> bool:
    """Whether two states go on alike: all but the SAR are equal, which may differ by what rounding leaves of a difference."""
    return a is None and b is None or bool(a and b) and (a[0], *a[2:]) == (b[0], *b[2:]) and abs(a[1] - b[1]) <= 1e-12 * max(1.0, abs(b[1]))


def sar_states(bars: DataFrame, first: float = ACCELERATION, most: float = MOST_ACCELERATION, block: int = SAR_BLOCK, lead: int = SAR_LEAD) -> tuple[DataFrame, int]:
    """``sym, b, in_*, out_*``: the states of a Parabolic SAR before and after each block of ``block`` rows (``bars`` has
    ``rn``), and the number of rounds that this took.

    A SAR's state is a recurrence that no algebra shortens, but it forgets: trends that turn on the same bar at the same
    extreme go on alike. All blocks are run at once, each from a state guessed by starting ``lead`` rows before it. A guess
    is right if it is the end of the block before. Blocks whose guess was wrong run again from that end, and on through
    the blocks behind them until one ends as it did before: through at most one block in the first round, two in the second, four
    in the third. So a stretch that forgets nothing, such as a flat one, of n blocks takes about log2(n) rounds, and
    one that forgets at once takes one. Rows stream through a task in order; it holds a batch of them."""
    narrow = bars.select("sym", "rn", "high", "low")
    names = [f"in_{c}" for c in SAR_STATE] + [f"out_{c}" for c in SAR_STATE]
    schema = f"sym string, b long, {_sar_fields('in_')}, {_sar_fields('out_')}"

    def guess(pdf: pd.DataFrame) -> pd.DataFrame:
        b, now, before = int(pdf["b"].iat[0]), None, None
        for rn, high, low in pdf.sort_values("rn")[["rn", "high", "low"]].itertuples(index=False):
            before = now if rn == b * block else before
            now = sar_step(now, high, low, first, most)
        return pd.DataFrame([[pdf["sym"].iat[0], b, *(before or (None,) * len(SAR_STATE)), *now]], columns=["sym", "b", *names])

    def go_on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, now, before, over = None, None, None, False
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.sym, r.head) != run:
                    run, over = (r.sym, r.head), False
                    now = before = None if pd.isna(r.in_sar) else (bool(r.in_rising), *(float(getattr(r, f"in_{c}")) for c in SAR_STATE[1:]))
                if over:
                    continue
                now = sar_step(now, r.high, r.low, first, most)
                if not pd.isna(r.was_sar):  # a block's last row, with the state in which it ended before
                    out.append([r.sym, r.b, *(before or (None,) * len(SAR_STATE)), *now])
                    over = _sar_same(now, (bool(r.was_rising), *(float(getattr(r, f"was_{c}")) for c in SAR_STATE[1:])))
                    before = now
            if out:
                yield pd.DataFrame(out, columns=["sym", "b", *names])

    home = F.floor(F.col("rn") / block).cast("long")
    own = narrow.withColumn("b", home)
    last = narrow.groupBy("sym").agg(F.max("rn").alias("top"))
    spread = narrow.withColumn("b", F.explode(F.sequence(home, F.floor((F.col("rn") + lead) / block).cast("long"))))
    spread = spread.join(last, "sym").where(F.col("b") * block <= F.col("top")).drop("top")
    states = cut(spread.groupBy("sym", "b").applyInPandas(guess, schema))
    exact = [c for c in SAR_STATE if c != "sar"]
    rounds = 0
    while True:
        ends = states.select("sym", (F.col("b") + 1).alias("b"), *[F.col(f"out_{c}").alias(f"end_{c}") for c in SAR_STATE])
        same = F.struct(*[f"in_{c}" for c in exact]).eqNullSafe(F.struct(*[f"end_{c}" for c in exact]))
        near = F.coalesce(F.abs(F.col("in_sar") - F.col("end_sar")) <= 1e-12 * F.greatest(F.lit(1.0), F.abs("end_sar")), F.lit(False))
        wrong = states.join(ends, ["sym", "b"]).where(~(same & near)).select("sym", F.col("b").alias("head"), *[F.col(f"end_{c}").alias(f"in_{c}") for c in SAR_STATE])
        # One row a wrong block; a run ends where the next one begins.
        following = F.lead("head").over(Window.partitionBy("sym").orderBy("head"))
        wrong = cut(wrong.withColumn("stop", F.least(F.col("head") + 2**rounds, F.coalesce(following, F.col("head") + 2**rounds))))
        if wrong.isEmpty():
            return states, rounds
        rounds += 1
        blocks = wrong.withColumn("b", F.explode(F.sequence("head", F.col("stop") - 1))).drop("stop")
        ended = states.select("sym", "b", *[F.col(f"out_{c}").alias(f"was_{c}") for c in SAR_STATE])
        rows = own.join(blocks.join(ended, ["sym", "b"]), ["sym", "b"]).join(last, "sym")
        at_end = (F.col("rn") == (F.col("b") + 1) * block - 1) | (F.col("rn") == F.col("top"))
        rows = rows.withColumns({f"was_{c}": F.when(at_end, F.col(f"was_{c}")) for c in SAR_STATE}).drop("top")
        mended = cut(rows.repartition("sym", "head").sortWithinPartitions("sym", "head", "rn").mapInPandas(go_on, schema))
        states = cut(states.join(mended.select("sym", "b"), ["sym", "b"], "left_anti").unionByName(mended))


def psar(bars: DataFrame, first: float = ACCELERATION, most: float = MOST_ACCELERATION, block: int = SAR_BLOCK, lead: int = SAR_LEAD) -> DataFrame:
    """Adds ``psar``, the Parabolic SAR while the trend is rising, null while it falls: each block of rows runs from its
    state in :func:`sar_states`, so the result is that of one run over all rows. Trends begin rising at the first bar."""
    rows = cut(positions(bars))
    states, _ = sar_states(rows, first, most, block, lead)

    def values(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        now, out = _sar_begin(pdf.iloc[0], "in_"), []
        for high, low in pdf[["high", "low"]].itertuples(index=False):
            now = sar_step(now, high, low, first, most)
            out.append(now[1] if now[0] else None)
        return pd.DataFrame({"sym": pdf["sym"].iat[0], "rn": pdf["rn"], "psar": out})

    own = rows.select("sym", "rn", "high", "low", F.floor(F.col("rn") / block).cast("long").alias("b"))
    begun = own.join(states.select("sym", "b", *[f"in_{c}" for c in SAR_STATE]), ["sym", "b"])
    return rows.join(begun.groupBy("sym", "b").applyInPandas(values, "sym string, rn long, psar double"), ["sym", "rn"])


def sar_last(bars: DataFrame) -> DataFrame:
    """``sym`` and the SAR's state after the symbol's last bar."""
    states, _ = sar_states(cut(positions(bars)))
    return states.groupBy("sym").agg(*[F.max_by(f"out_{c}", "b").alias(c) for c in SAR_STATE])


def obv(bars: DataFrame) -> DataFrame:
    """Adds ``obv``, the running volume signed by the direction of close; the first bar counts as rising."""
    b = lagged(positions(bars), ["close"])
    return running(b.withColumn("__v", F.coalesce(F.signum(F.col("close") - F.col("close_prev")), F.lit(1.0)) * F.col("volume")), "__v", "obv").drop(
        "__v", "close_prev",
    )


def regimes(indicators: DataFrame) -> DataFrame:
    """Adds ``trend`` (trending at an adx of 25 or more, not_trending at 20 or less, else neutral), ``range`` (bands
    narrower than 0.7 of their median width over 40 bars) and ``market``: volatile, trending, ranging or normal, the
    first that holds."""
    trend = F.when(F.col("adx") >= 25, "trending").when(F.col("adx") <= 20, "not_trending").otherwise("neutral")
    narrow = F.when(F.col("bb_width") < 0.7 * F.col("bb_width_median"), "range").otherwise("not_range")
    r = regime_volatility(indicators).withColumn("trend", trend).withColumn("range", narrow)
    return r.withColumn(
        "market",
        F.when(F.col("regime") == "volatile", "volatile").when(F.col("trend") == "trending", "trending").when(F.col("range") == "range", "ranging").otherwise("normal"),
    )
