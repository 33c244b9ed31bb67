"""The whole set of indicators of a series, and those of longer bars joined to shorter ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import indicators as ind
from tidemill.operators.bars import asof_backward, enough_rows, resample_ohlcv
from tidemill.operators.cleaning import drop_after_warmup, fill
from tidemill.operators.core import cut, row_position

#: Spans of the exponential means.
SPANS = (9, 20, 50, 100, 200)
#: Columns of longer bars that are joined to shorter ones.
HTF = ("sma_20", "ema_20", "rsi_14", "macd", "bb_upper", "bb_lower", "atr_14", "adx_14", "obv")


def indicator_set(bars: DataFrame, warmup: int = 50) -> DataFrame:
    """``bars`` with ``rn`` and all finite and recurrent indicators, nulls filled from later rows and then from earlier
    ones; after ``warmup`` bars, rows that still lack a value fall away (as where a symbol never has it). ``bb_middle`` is
    the mean between the bands, ``adx_14`` that of :func:`indicators.adx`."""
    b = cut(row_position(bars))
    whole = ind.finite_indicators(b).drop("true_range", "diff", "tp", "bb_mid", "bb_sd", "fast_k").withColumn("bb_middle", F.col("sma_20"))
    for rows in (ind.macd(b, SPANS), ind.wilder_set(b).withColumnRenamed("adx", "adx_14"), ind.obv(b), ind.psar(b)):
        added = [c for c in rows.columns if c not in b.columns and c not in ("ema_12", "ema_26")]
        whole = whole.join(rows.select("sym", "rn", *added), ["sym", "rn"], "left")
    added = [c for c in whole.columns if c not in b.columns]
    return drop_after_warmup(fill(cut(whole), added, backward_first=True), added, warmup)


def htf_features(
    bars: DataFrame, ticks: DataFrame, rules: dict[str, str], columns: tuple[str, ...] = HTF, least: int = 20, warmup: int = 50,
    availability: str = "open",
) -> DataFrame:
    """``bars`` with the ``columns`` of longer bars (``rules``: prefix and length), named ``<prefix>_<column>``: those of the
    latest longer bar that began at or before each one (``availability`` "open", which looks ahead into a bar that isn't
    over), or that was over by then ("close"). Symbols with fewer than ``least`` longer bars have none. Nulls are filled
    from later rows, then from earlier ones; after ``warmup`` bars, rows that still lack a value fall away."""
    if availability not in ("open", "close"):
        raise ValueError("availability is open or close")
    out = row_position(bars)
    names = []
    for prefix, rule in rules.items():
        longer = indicator_set(enough_rows(resample_ohlcv(ticks, rule), least), warmup)
        known = F.col("ts") + F.expr(f"interval {rule}") if availability == "close" else F.col("ts")
        renamed = longer.select("sym", known.alias("ts"), *[longer[c].alias(f"{prefix}_{c}") for c in columns])
        out = cut(asof_backward(out, renamed, [f"{prefix}_{c}" for c in columns]))
        names += [f"{prefix}_{c}" for c in columns]
    return drop_after_warmup(fill(out, names, backward_first=True), names, warmup)
