"""Queries of the whole set of indicators and of longer bars' indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators import indicators as ind
from tidemill.operators.bars import ticks
from tidemill.operators.features import HTF, SPANS, htf_features, indicator_set
from tidemill.plans.modelling import LAGS, A
from tidemill.plans.quality import AHEAD, TS, UP, positioned
from tidemill.plans.queries import BARS, FAST, LAG, RANGE, TR, _bars_sql, _full, _lr, _sma, _w, add, bars, shown, table

ONE_BACK = "(PARTITION BY sym ORDER BY rn)"
RSI = (2, 7, 14)


def _rsi(n: int) -> str:
    up, down = _lr("rise", f"(1.0::DOUBLE / {n})"), _lr("fall", f"(1.0::DOUBLE / {n})")
    return f"CASE WHEN {down} = 0 THEN 100 ELSE 100 - 100 / (1 + {up} / {down}) END AS rsi_{n}"


#: The Parabolic SAR as a walk over the rows of each symbol of ``bars``.
SAR = """sar AS (
  SELECT sym, rn, TRUE AS rising, low AS sar, high AS extreme, 0.02::DOUBLE AS speed, high AS h1, low AS l1, high AS h2, low AS l2 FROM bars WHERE rn = 0
  UNION ALL
  SELECT sym, rn, CASE WHEN turned THEN NOT rising ELSE rising END, CASE WHEN turned THEN extreme ELSE s END,
    CASE WHEN turned AND rising THEN low WHEN turned THEN high WHEN rising THEN greatest(extreme, high) ELSE least(extreme, low) END,
    CASE WHEN turned THEN 0.02 WHEN (rising AND high > extreme) OR (NOT rising AND low < extreme) THEN least(speed + 0.02::DOUBLE, 0.2::DOUBLE) ELSE speed END,
    high, low, h1, l1
  FROM (SELECT *, (rising AND low < s) OR (NOT rising AND high > s) AS turned FROM (
    SELECT b.sym, b.rn, b.high, b.low, rising, extreme, speed, h1, l1,
      CASE WHEN rising THEN least(sar + speed * (extreme - sar), l1, l2) ELSE greatest(sar + speed * (extreme - sar), h1, h2) END AS s
    FROM sar JOIN bars b ON b.sym = sar.sym AND b.rn = sar.rn + 1)))"""


def indicators_sql() -> tuple[str, list[str]]:
    """CTEs from a table ``bars`` (``sym, ts, rn`` and prices) to ``whole`` with every indicator, and their names."""
    roc = [f"100 * (close / nullif(lag(close, {n}) OVER {ONE_BACK}, 0) - 1) AS roc_{n}" for n in (1, 5, 15)]
    spans = [f"{_lr('close', f'(2.0::DOUBLE / {n + 1})')} AS ema_{n}" for n in SPANS]
    five = _w(3, 2)
    first = [
        *[f"{_sma('close', n)} AS sma_{n}" for n in (10, 20, 50)],
        f"{_full(f'stddev_pop(close) {_w(20)}', 'close', 20)} AS bb_std",
        f"100 - 100 / (1 + avg(r0) {_w(14)} / (avg(f0) {_w(14)} + 1e-9)) AS rsi_sma",
        f"{_full(f'-100 * (max(high) {_w(14)} - close) / nullif({RANGE}, 0)', 'close', 14)} AS willr_14",
        *roc,
        f"{_sma('tr0', 14)} AS atr_sma",
        f"{_sma('volume', 14)} - {_sma('volume', 28)} AS volume_osc",
        f"CASE WHEN count(*) {five} = 5 AND high = max(high) {five} THEN 1 ELSE 0 END AS fractal_high",
        f"CASE WHEN count(*) {five} = 5 AND low = min(low) {five} THEN 1 ELSE 0 END AS fractal_low",
        f"{_full(f'4 * stddev_samp(close) {_w(20)}', 'close', 20)} / close AS bb_width",
        f"sum(signed) OVER {ONE_BACK} AS obv",
        f"avg(tp) {_w(20)} AS tp_mean, list(tp) {_w(20)} AS tps",
        f"{FAST} AS fast_k",
        *spans,
        f"{_lr('close', '(2.0::DOUBLE / 13)')} - {_lr('close', '(2.0::DOUBLE / 27)')} AS macd",
    ]
    second = [
        "sma_20 + 2 * bb_std AS bb_upper, sma_20 - 2 * bb_std AS bb_lower, sma_20 AS bb_middle",
        f"{_sma('fast_k', 3)} AS stoch_k",
        "CASE WHEN len(tps) = 20 THEN (tp - tp_mean) / nullif(0.015 * list_sum(list_transform(tps, lambda v: abs(v - tp_mean))) / 20, 0) END AS cci_20",
        f"{_full(f'median(atr_sma) {_w(28)}', 'atr_sma', 28)} AS atr_median",
        f"{_full(f'median(bb_width) {_w(40)}', 'bb_width', 40)} AS bb_width_median",
        f"{_lr('macd', '0.2::DOUBLE')} AS macd_signal",
    ]
    third = [f"{_sma('stoch_k', 3)} AS stoch_d", "macd - macd_signal AS macd_diff"]
    moves = """CASE WHEN high - h1 > l1 - low AND high > h1 THEN high - h1 ELSE 0 END::DOUBLE AS pdm, CASE WHEN l1 - low > high - h1 AND low < l1 THEN l1 - low ELSE 0 END::DOUBLE AS mdm"""
    sql = f"""{LAGS.lstrip(', ')}, m AS (SELECT *, greatest(close - c1, 0) AS rise, greatest(c1 - close, 0) AS fall, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr, {moves} FROM v WHERE rn >= 1),
w1 AS (SELECT sym, rn, {', '.join(_rsi(n) for n in RSI)}, {_lr('tr', A)} AS atr_14, {_lr('pdm', A)} AS p, {_lr('mdm', A)} AS q FROM m),
w2 AS (SELECT *, 100 * p / nullif(atr_14, 0) AS di_plus, 100 * q / nullif(atr_14, 0) AS di_minus, coalesce(100 * abs(p - q) / nullif(p + q, 0), 0) AS dx FROM w1),
w3 AS (SELECT *, {_lr('dx', A)} AS adx_14 FROM w2),
f0 AS (SELECT *, {TR} AS tr0, (high + low + close) / 3 AS tp, coalesce(greatest(close - {LAG}, 0), 0) AS r0, coalesce(greatest({LAG} - close, 0), 0) AS f0,
  coalesce(sign(close - {LAG}), 1) * volume AS signed FROM bars),
f1 AS (SELECT *, {', '.join(first)} FROM f0), f2 AS (SELECT *, {', '.join(second)} FROM f1), f3 AS (SELECT *, {', '.join(third)} FROM f2),
{SAR}, whole AS (SELECT f3.*, w3.* EXCLUDE (sym, rn, p, q, dx), CASE WHEN sar.rising THEN sar.sar END AS psar
                 FROM f3 LEFT JOIN w3 ON f3.sym = w3.sym AND f3.rn = w3.rn JOIN sar ON f3.sym = sar.sym AND f3.rn = sar.rn)"""
    names = [x.rsplit(" ", 1)[1] for part in (*first, *second, *third) for x in part.split(", ") if " AS " in x]
    names = [n for n in names if n not in ("tp_mean", "tps", "fast_k")]
    return sql, [*names, *[f"rsi_{n}" for n in RSI], "atr_14", "di_plus", "di_minus", "adx_14", "psar"]


def _filled(c: str) -> str:
    return f"coalesce(first_value({c} IGNORE NULLS) OVER {AHEAD}, last_value({c} IGNORE NULLS) OVER {UP})"


def _shown(c: str, name: str) -> str:
    return f"{c}::INTEGER AS {name}" if "fractal" in name else f'round({c}, 6) AS "{name}"'


CTES, NAMES = indicators_sql()
RECURSIVE = BARS.replace("WITH ", "WITH RECURSIVE ", 1)
add(
    "psar",
    lambda s, d: shown(ind.psar(positioned(s, d)), "psar"),
    f"{RECURSIVE}, {SAR} SELECT sym, {TS}, round(CASE WHEN rising THEN sar END, 6) AS psar FROM sar JOIN bars USING (sym, rn)",
)


def _set(s: SparkSession, d: str) -> DataFrame:
    found = indicator_set(bars(s, d))
    whole = {c: "double" if "fractal" not in c else "int" for c in found.columns if c in NAMES}
    return shown(found.withColumns({c: found[c].cast(kind) for c, kind in whole.items()}), *NAMES)


add("indicator_set", _set, f"{RECURSIVE}, {CTES} SELECT sym, {TS}, {', '.join(_shown(_filled(c), c) for c in NAMES)} FROM whole")
RULES = {"5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "4h": "4 hours"}


def _longer(s: SparkSession, d: str, prefix: str, availability: str) -> DataFrame:
    """Hourly bars with the indicators of one rule's bars."""
    found = htf_features(bars(s, d), ticks(table(s, d, "events")), {prefix: RULES[prefix]}, availability=availability)
    return shown(found, *[f"{prefix}_{c}" for c in HTF])


def _longer_sql(prefix: str, availability: str) -> str:
    rule = RULES[prefix].upper().rstrip("S")
    inner = "lb AS (SELECT sym, b AS ts, open, high, low, close, volume, row_number() OVER (PARTITION BY sym ORDER BY b) - 1 AS rn FROM longer)"
    ctes = CTES.replace("FROM bars", "FROM lb").replace("JOIN bars b", "JOIN lb b")
    hf = ", ".join(f'{_filled(c)} AS "{prefix}_{c}"' for c in HTF)
    joined = ", ".join(f'h."{prefix}_{c}"' for c in HTF)
    last = ", ".join(_shown(_filled(f'"{prefix}_{c}"'), f"{prefix}_{c}") for c in HTF)
    known = f"h.ts + INTERVAL {rule}" if availability == "close" else "h.ts"
    return f"""{RECURSIVE}, {_bars_sql("longer", rule)}, {inner}, {ctes}, hf AS (SELECT sym, ts, {hf} FROM whole),
j AS (SELECT bars.sym, bars.ts, bars.rn, {joined} FROM bars ASOF LEFT JOIN hf h ON bars.sym = h.sym AND bars.ts >= {known}) SELECT sym, {TS}, {last} FROM j"""


for _p in RULES:
    add(f"htf_features_{_p}", lambda s, d, p=_p: _longer(s, d, p, "open"), _longer_sql(_p, "open"))
add("htf_features_4h_close", lambda s, d: _longer(s, d, "4h", "close"), _longer_sql("4h", "close"))
