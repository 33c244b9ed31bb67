"""Queries of recurrent indicators, regimes, targets, folds, scaling, drift and ensembles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import indicators as ind
from tidemill.operators import learning as le
from tidemill.operators import metrics
from tidemill.operators.bars import asof_backward
from tidemill.operators.core import row_position
from tidemill.operators.folds import register_folds
from tidemill.plans.quality import HOLES, TS, holes, positioned, rounded
from tidemill.plans.queries import BARS, ORACLE_SQL, SCORED, TR, X_ATR, _bars_sql, _lr, _scored, _w, add, bars, shown, table

LAGS = (
    ", v AS (SELECT *, lag(close) OVER o AS c1, lag(high) OVER o AS h1, lag(low) OVER o AS l1 FROM bars WINDOW o AS "
    "(PARTITION BY sym ORDER BY rn))"
)
MOVES = f"""{BARS}{LAGS}, m AS (SELECT *, greatest(close - c1, 0) AS rise, greatest(c1 - close, 0) AS fall, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr,
CASE WHEN high - h1 > l1 - low AND high > h1 THEN high - h1 ELSE 0 END::DOUBLE AS pdm, CASE WHEN l1 - low > high - h1 AND low < l1 THEN l1 - low ELSE 0 END::DOUBLE AS mdm FROM v WHERE rn >= 1)"""
A = "(1.0::DOUBLE / 14)"
add(
    "rsi_wilder",
    lambda s, d: shown(ind.rsi_wilder(positioned(s, d)), "rsi_14"),
    f"{MOVES}, r AS (SELECT *, {_lr('rise', A)} AS u, {_lr('fall', A)} AS f FROM m) SELECT sym, {TS}, round(CASE WHEN f = "
    "0 THEN 100 ELSE 100 - 100 / (1 + u / f) END, 6) AS rsi_14 FROM r",
)
add(
    "atr_wilder",
    lambda s, d: shown(ind.atr_wilder(positioned(s, d)), "atr_14"),
    f"{MOVES} SELECT sym, {TS}, round({_lr('tr', A)}, 6) AS atr_14 FROM m",
)
ADX = f"""{MOVES}, r AS (SELECT *, {_lr('pdm', A)} AS p, {_lr('mdm', A)} AS q, {_lr('tr', A)} AS t FROM m), x1 AS (SELECT *, coalesce(100 * abs(p - q) / nullif(p + q, 0), 0) AS dx FROM r),
a AS (SELECT *, {_lr('dx', A)} AS adx FROM x1)"""
add(
    "adx",
    lambda s, d: shown(ind.adx(positioned(s, d)), "di_plus", "di_minus", "adx"),
    f"{ADX} SELECT sym, {TS}, round(100 * p / t, 6) AS di_plus, round(100 * q / t, 6) AS di_minus, round(adx, 6) AS adx FROM a",
)
add(
    "obv",
    lambda s, d: shown(ind.obv(positioned(s, d)), "obv"),
    f"{BARS}{LAGS} SELECT sym, {TS}, round(sum(coalesce(sign(close - c1), 1) * volume) OVER (PARTITION BY sym ORDER BY "
    "rn), 6) AS obv FROM v",
)


def _regimes(s: SparkSession, d: str) -> DataFrame:
    b = positioned(s, d)
    return ind.regimes(ind.finite_indicators(b).join(ind.adx(b).select("sym", "rn", "adx"), ["sym", "rn"], "left"))


_FULL20 = f"CASE WHEN count(close) {_w(20)} = 20 THEN 4 * stddev_samp(close) {_w(20)} END / close"
REGIMES = f"""{ADX}{X_ATR.replace(' z AS', ' z1 AS').replace('FROM z)', 'FROM z1)')}, b1 AS (SELECT sym, rn, {_FULL20} AS width FROM bars),
b2 AS (SELECT *, CASE WHEN count(width) {_w(40)} = 40 THEN median(width) {_w(40)} END AS wm FROM b1),
g AS (SELECT x.sym, x.ts, x.rn, CASE WHEN x.atr > 1.5 * x.med THEN 'volatile' ELSE 'normal' END AS vol, CASE WHEN adx >= 25 THEN 'trending' WHEN adx <= 20 THEN 'not_trending' ELSE 'neutral' END AS trend,
CASE WHEN width < 0.7 * wm THEN 'range' ELSE 'not_range' END AS "range" FROM x JOIN b2 USING (sym, rn) LEFT JOIN a USING (sym, rn)),
k AS (SELECT *, CASE WHEN vol = 'volatile' THEN 'volatile' WHEN trend = 'trending' THEN 'trending' WHEN "range" = 'range' THEN 'ranging' ELSE 'normal' END AS market FROM g)"""
add("regime_trend", lambda s, d: shown(_regimes(s, d), "trend"), f"{REGIMES} SELECT sym, {TS}, trend FROM k")
add("regime_range", lambda s, d: shown(_regimes(s, d), "range"), f'{REGIMES} SELECT sym, {TS}, "range" FROM k')
add("regime_classify", lambda s, d: shown(_regimes(s, d), "market"), f"{REGIMES} SELECT sym, {TS}, market FROM k")
add(
    "regime_latest",
    lambda s, d: _regimes(s, d).groupBy("sym").agg(F.max_by("market", "rn").alias("market")),
    f"{REGIMES} SELECT sym, arg_max(market, rn) AS market FROM k GROUP BY sym",
)

add(
    "forward_max_target",
    lambda s, d: shown(le.forward_max_target(positioned(s, d), 60, 50.0), "target"),
    f"{BARS} SELECT sym, {TS}, CASE WHEN lead(rn, 60) OVER (PARTITION BY sym ORDER BY rn) IS NOT NULL AND max(close) OVER "
    "(PARTITION BY sym ORDER BY rn ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) - close >= 50 THEN 1 ELSE 0 END AS target "
    "FROM bars",
)
add(
    "forward_max_target_known",
    lambda s, d: shown(le.forward_max_target(positioned(s, d), 60, 50.0, tail="null"), "target"),
    f"{BARS} SELECT sym, {TS}, CASE WHEN lead(rn, 60) OVER (PARTITION BY sym ORDER BY rn) IS NOT NULL THEN (max(close) OVER "
    "(PARTITION BY sym ORDER BY rn ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) - close >= 50)::INTEGER END AS target FROM bars",
)


def _sequences(s: SparkSession, d: str) -> DataFrame:
    b = positioned(s, d).withColumn("v", F.col("volume").cast("long"))
    q = le.make_sequences(b.withColumn("label", F.col("v") % 2), ["v", "rn"], 5, "label", 1)
    return shown(q.withColumn("sequence", F.array_join(F.flatten("sequence").cast("array<string>"), " ")), "sequence", "label")


SEQ = (
    f"{BARS}, y AS (SELECT *, volume::BIGINT AS v, list(volume::BIGINT || ' ' || rn) {_w(5)} AS l, lead(volume::BIGINT % "
    "2) OVER (PARTITION BY sym ORDER BY rn) AS label FROM bars)"
)
add(
    "make_sequences",
    _sequences,
    f"{SEQ} SELECT sym, {TS}, array_to_string(l, ' ') AS sequence, label FROM y WHERE len(l) = 5 AND label IS NOT NULL",
)
COUNTED = f"{BARS}, c AS (SELECT *, count(*) OVER (PARTITION BY sym) AS n FROM bars), n AS (SELECT sym, count(*) AS n FROM bars GROUP BY sym)"
add(
    "split_time",
    lambda s, d: shown(le.split_time(positioned(s, d)), "part"),
    f"{COUNTED} SELECT sym, {TS}, CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn < floor(n * (0.7::DOUBLE + "
    "0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS part FROM c",
)
add(
    "split_holdout",
    lambda s, d: shown(le.split_holdout(positioned(s, d)), "part"),
    f"{COUNTED}, h AS (SELECT *, n - ceil(n * 0.2::DOUBLE) AS m FROM c) SELECT sym, {TS}, CASE WHEN rn >= m THEN 'test' "
    "WHEN rn >= m - ceil(m * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS part FROM h",
)


def _counted(s: SparkSession, d: str) -> DataFrame:
    return positioned(s, d).groupBy("sym").agg(F.count(F.lit(1)).alias("n"))


SPLIT = f"{COUNTED}, f AS (SELECT sym, k AS fold, n, n // 6 AS t, n // 6 + k * 40 AS a FROM n, range(0, 5) r(k))"
SPLITS = (
    "SELECT sym, fold::INTEGER AS fold, greatest(0, a - 200) AS train_start, a AS train_end, a AS test_start, a + t AS "
    "test_end FROM f WHERE a + t <= n"
)


def _splits(s: SparkSession, d: str) -> DataFrame:
    return le.cv_timeseries_split(_counted(s, d), 5, 40, max_train=200)


add("cv_timeseries_split", _splits, f"{SPLIT} {SPLITS}")
add(
    "cv_rolling_window",
    lambda s, d: le.cv_rolling_window(_counted(s, d), 100, 50, 25),
    f"{COUNTED}, f AS (SELECT sym, n, unnest(range(0, n - 124, 50)) AS a FROM n) SELECT sym, (a / 50)::INTEGER AS fold, a "
    "AS train_start, a + 100 AS train_end, a + 100 AS test_start, a + 125 AS test_end FROM f",
)
add(
    "cv_expanding_window",
    lambda s, d: le.cv_expanding_window(_counted(s, d), 100, 50, 25),
    f"{COUNTED}, f AS (SELECT sym, n, unnest(range(100, n - 24, 50)) AS a FROM n) SELECT sym, ((a - 100) / 50)::INTEGER "
    "AS fold, 0::BIGINT AS train_start, a AS train_end, a AS test_start, a + 25 AS test_end FROM f",
)
add(
    "fold_range_join",
    lambda s, d: shown(le.fold_rows(positioned(s, d), _splits(s, d)), "fold", "role"),
    f"{SPLIT}, q AS ({SPLITS}) SELECT bars.sym, {TS}, fold, CASE WHEN rn < train_end THEN 'train' ELSE 'test' END AS role "
    "FROM bars JOIN q ON bars.sym = q.sym AND rn >= train_start AND rn < test_end",
)
add(
    "cv_stability",
    lambda s, d: rounded(le.stability(le.fold_rows(positioned(s, d), _splits(s, d)).where("role = 'test'").groupBy("sym", "fold").agg(F.avg("close").alias("score")), "score")),
    f"{SPLIT}, q AS ({SPLITS}), e AS (SELECT avg(close) AS score FROM bars JOIN q ON bars.sym = q.sym AND rn >= "
    "test_start AND rn < test_end GROUP BY q.sym, fold) SELECT round(avg(score), 6) AS mean_score, "
    "round(stddev_pop(score), 6) AS std_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, "
    "round(stddev_pop(score) / avg(score), 6) AS cv_score FROM e",
)


def _folds_of(s: SparkSession, d: str, arguments: str) -> DataFrame:
    """The folds of the table function, from SQL."""
    register_folds(s)
    view = f"counts_{uuid.uuid4().hex}"
    _counted(s, d).createOrReplaceTempView(view)
    return s.sql(f"SELECT * FROM cv_folds(TABLE(SELECT sym, n FROM {view}) PARTITION BY sym, {arguments})")


for _kind, _arguments in (
    ("cv_timeseries_split", "kind => 'timeseries', splits => 5, step => 40, max_train => 200"),
    ("cv_rolling_window", "kind => 'rolling', window => 100, step => 50, test => 25"),
    ("cv_expanding_window", "kind => 'expanding', start => 100, step => 50, test => 25"),
):
    add(f"fold_udtf_{_kind[3:]}", lambda s, d, a=_arguments: _folds_of(s, d, a), ORACLE_SQL[_kind])


def _cells(s: SparkSession, d: str) -> DataFrame:
    grid = s.createDataFrame([(depth, trees) for depth in (2, 4) for trees in (10, 20)], "depth long, trees long")
    return le.param_grid_cross(_splits(s, d), grid).select("sym", "fold", "test_start", "depth", "trees")


add(
    "param_grid_cross",
    _cells,
    f"{SPLIT}, q AS ({SPLITS}) SELECT sym, fold, test_start, depth, trees FROM q, (VALUES (2::BIGINT), (4::BIGINT)) "
    "a(depth), (VALUES (10::BIGINT), (20::BIGINT)) b(trees)",
)


def _part(s: SparkSession, d: str) -> DataFrame:
    return le.split_time(holes(s, d))


TRAIN = f"{HOLES}, t AS (SELECT *, coalesce(x, 0) AS z, rn < floor(count(*) OVER (PARTITION BY sym) * 0.7::DOUBLE) AS tr FROM d)"
add(
    "scale_standard",
    lambda s, d: shown(le.scale(_part(s, d), ["x"], "standard", F.col("part") == "train"), "x"),
    f"{TRAIN}, q AS (SELECT avg(z) AS m, stddev_pop(z) AS sd FROM t WHERE tr) SELECT sym, {TS}, round((z - m) / sd, 6) AS "
    "x FROM t, q",
)
add(
    "scale_minmax",
    lambda s, d: shown(le.scale(_part(s, d), ["x"], "minmax", F.col("part") == "train"), "x"),
    f"{TRAIN}, q AS (SELECT min(z) AS m, max(z) - min(z) AS sd FROM t WHERE tr) SELECT sym, {TS}, round((z - m) / sd, 6) "
    "AS x FROM t, q",
)
add(
    "scale_robust",
    lambda s, d: shown(le.scale(_part(s, d), ["x"], "robust", F.col("part") == "train"), "x"),
    f"{TRAIN}, q AS (SELECT quantile_cont(z, 0.5) AS m, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS sd FROM t WHERE tr) SELECT sym, {TS}, round((z - m) / sd, 6) AS x FROM t, q",
)
L = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
add(
    "variance_select",
    lambda s, d: rounded(le.variance_select(table(s, d, "lineitem"), L, 0.001)),
    "SELECT \"column\", round(v, 6) AS variance FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_pop(coalesce({c}, 0)) AS v FROM lineitem" for c in L) + ") WHERE v > 0.001",
)
add(
    "correlation_select",
    lambda s, d: le.correlation_select(table(s, d, "lineitem"), L, 0.5),
    "SELECT 'l_quantity' AS \"column\" UNION ALL " + " UNION ALL ".join(f"SELECT '{c}' FROM lineitem HAVING greatest({', '.join(f'abs(corr({e}, {c}))' for e in L[:k])}) <= 0.5" for k, c in enumerate(L) if k),
)
PROB = "((hour(ts) * 7919 + day(ts) * 104729 + length(sym)) * {m} % 1000) / 1000"


def _preds(s: SparkSession, d: str) -> DataFrame:
    """Three models' probabilities for each bar; the third has none where the bars have holes."""
    models = [F.struct(F.lit(f"m{m}").alias("model"), F.expr(PROB.format(m=m)).alias("prob")) for m in (1, 3, 7)]
    p = holes(s, d).select("sym", "ts", "rn", "x", F.inline(F.array(*models)))
    return p.withColumn("prob", F.when((F.col("model") != "m7") | F.col("x").isNotNull(), F.col("prob")))


PREDS = f"{HOLES}, p AS (" + " UNION ALL ".join(f"SELECT sym, ts, rn, 'm{m}' AS model, {'CASE WHEN x IS NOT NULL THEN ' if m == 7 else ''}{PROB.format(m=m)}{' END' if m == 7 else ''} AS prob FROM d" for m in (1, 3, 7)) + ")"
add(
    "ensemble_simple",
    lambda s, d: shown(le.ensemble_simple(_preds(s, d), ["sym", "ts"]), "prob", "confidence"),
    f"{PREDS} SELECT sym, {TS}, round(avg(prob), 6) AS prob, round(1.0::DOUBLE / count(prob), 6) AS confidence FROM p "
    "GROUP BY p.sym, p.ts",
)
add(
    "ensemble_mean",
    lambda s, d: shown(_preds(s, d).groupBy("sym", "ts").agg(F.avg("prob").alias("prob")), "prob"),
    f"{PREDS} SELECT sym, {TS}, round(avg(prob), 6) AS prob FROM p GROUP BY p.sym, p.ts",
)


def _weighted(s: SparkSession, d: str) -> DataFrame:
    p = _preds(s, d)
    perf = p.groupBy("sym", "model").agg(F.avg(F.col("prob") * F.col("prob")).alias("perf"))
    return le.ensemble_weighted(p.join(perf, ["sym", "model"]), ["sym", "ts"], "perf")


add(
    "ensemble_weighted",
    lambda s, d: shown(_weighted(s, d), "prob", "confidence"),
    f"{PREDS}, w AS (SELECT sym, model, avg(prob * prob) AS perf FROM p GROUP BY 1, 2) SELECT p.sym, strftime(p.ts, "
    "'%Y-%m-%d %H:%M:%S') AS ts, round(sum(prob * perf) / sum(perf), 6) AS prob, round(max(perf) / sum(perf), 6) AS "
    "confidence FROM p JOIN w USING (sym, model) WHERE prob IS NOT NULL GROUP BY p.sym, p.ts",
)
add(
    "ensemble_vote",
    lambda s, d: shown(le.ensemble_vote(_preds(s, d).withColumn("v", (F.col("prob") > 0.5).cast("int")), ["sym", "ts"], "v"), "vote", "confidence"),
    f"{PREDS}, c AS (SELECT sym, ts, (prob > 0.5)::INTEGER AS v, count(*) AS c FROM p WHERE prob IS NOT NULL GROUP BY "
    "p.sym, p.ts, 3) SELECT sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, arg_max(v, (c, -v)) AS vote, round(max(c) / "
    "sum(c), 6) AS confidence FROM c GROUP BY c.sym, c.ts",
)
SWEEP = [0.5, 0.65, 0.8, 2.0]
add(
    "threshold_sweep",
    lambda s, d: rounded(le.threshold_sweep(_preds(s, d), "prob", SWEEP)),
    " UNION ALL ".join(f"SELECT * FROM ({PREDS} SELECT {t}::DOUBLE AS threshold, round(coalesce(avg(prob) FILTER (prob > {t}), '-infinity'::DOUBLE), 6) AS score FROM p)" for t in SWEEP),
)
add(
    "ab_assign",
    lambda s, d: le.ab_assign(table(s, d, "customer"), "c_custkey", 0.3, "s").select("c_custkey", "version"),
    "SELECT c_custkey, CASE WHEN ('0x' || substr(md5('s' || c_custkey), 1, 8))::BIGINT / 4294967296 < 0.3 THEN 'A' ELSE "
    "'B' END AS version FROM customer",
)


def _frame(b: DataFrame, frame: str) -> DataFrame:
    """EMA and RSI of bars, named for their time frame; RSI is null in a symbol's first row."""
    both = ind.emas(b, (20,)).select("sym", "ts", "rn", F.col("ema_20").alias(f"{frame}_ema_20"))
    rsi = ind.rsi_wilder(b).select("sym", "rn", F.col("rsi_14").alias(f"{frame}_rsi_14"))
    return both.join(rsi, ["sym", "rn"], "left").drop("rn")


def _multi(s: SparkSession, d: str) -> DataFrame:
    b = positioned(s, d)
    longer = asof_backward(b, _frame(row_position(bars(s, d, "4 hours")), "4h"), ["4h_ema_20", "4h_rsi_14"])
    return le.signal_multi_timeframe(longer.join(_frame(b, "1h"), ["sym", "ts"]).withColumn("prob", F.expr(PROB.format(m=1))))


def _frame_sql(source: str, name: str) -> str:
    """CTEs with ``ema`` and ``rsi`` of the bars in ``source``."""
    return f"""{name}0 AS (SELECT *, close - lag(close) OVER (PARTITION BY sym ORDER BY rn) AS dc, {_lr('close', '(2.0::DOUBLE / 21)')} AS ema FROM {source}),
{name}1 AS (SELECT sym, rn, {_lr('greatest(dc, 0)', A)} AS u, {_lr('greatest(-dc, 0)', A)} AS f FROM {name}0 WHERE rn >= 1),
{name} AS (SELECT {name}0.sym, ts, ema, CASE WHEN f = 0 THEN 100 ELSE 100 - 100 / (1 + u / f) END AS rsi FROM {name}0 LEFT JOIN {name}1 USING (sym, rn))"""


def _side_sql(op: str) -> str:
    return " AND ".join(f"close {op} {n}.ema AND {n}.rsi {op} 50" for n in ("fh", "fl"))


MULTI = f"""{BARS}, {_bars_sql('longer', '4 HOUR')}, lb AS (SELECT sym, b AS ts, close, row_number() OVER (PARTITION BY sym ORDER BY b) - 1 AS rn FROM longer),
{_frame_sql('bars', 'fh')}, {_frame_sql('lb', 'fl')}
SELECT bars.sym, strftime(bars.ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN prob < 0.55 THEN 'Flat' WHEN {_side_sql('>')} THEN 'Long' WHEN {_side_sql('<')} THEN 'Short' ELSE 'Flat' END AS signal
FROM (SELECT *, {PROB.format(m=1)} AS prob FROM bars) bars JOIN fh ON bars.sym = fh.sym AND bars.ts = fh.ts ASOF LEFT JOIN fl ON bars.sym = fl.sym AND bars.ts >= fl.ts"""
add("signal_multi_timeframe", lambda s, d: shown(_multi(s, d), "signal"), MULTI)
PSCORE = "least(s, 3000) / 3000"
add(
    "log_loss",
    lambda s, d: rounded(metrics.log_loss(_scored(s, d).withColumn("q", F.least(F.col("s"), F.lit(3000)) / 3000), "y", "q")),
    SCORED + f", q AS (SELECT y, greatest(least({PSCORE}, 1 - 1e-15), 1e-15) AS q FROM m) SELECT round(-avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss FROM q",
)
add(
    "weighted_class_report",
    lambda s, d: rounded(metrics.weighted_class_report(_scored(s, d), "y", "p")),
    SCORED + ", c AS (SELECT k, count(*) FILTER (y = k) AS n, count(*) FILTER (p = k) AS said, count(*) FILTER (y = k AND p = k) AS tp FROM m, (VALUES (0), (1)) v(k) GROUP BY k) SELECT round(sum(n * coalesce(tp / nullif(said, 0), 0)) / sum(n), 6) AS precision, round(sum(n * coalesce(tp / nullif(n, 0), 0)) / sum(n), 6) AS recall, round(sum(n * coalesce(2 * tp / nullif(said + n, 0), 0)) / sum(n), 6) AS f1 FROM c",
)


def _drift(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").withColumn("late", F.expr("int(l_shipdate >= timestamp_ntz'1997-01-01 00:00:00')"))


DRIFT = "WITH t AS (SELECT *, (l_shipdate >= TIMESTAMP '1997-01-01')::INTEGER AS late FROM lineitem)"
def _ks_sql(column: str, table: str = "t") -> str:
    """A query of ``statistic, p_value`` of the Kolmogorov-Smirnov test, by running counts."""
    return f"""SELECT round(d, 6) AS statistic, round(CASE WHEN d * sc < 0.2 THEN 1 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 101),
lambda i: 2 * (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * i * i * d * sc * d * sc))))) END, 6) AS p_value
FROM (SELECT max(abs(ca / na - cb / nb)) AS d, max(sqrt(na::DOUBLE * nb / (na + nb))) AS sc
FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb
FROM (SELECT {column} AS v, count(*) FILTER (late = 0) AS a, count(*) FILTER (late = 1) AS b FROM {table} GROUP BY 1)))"""


def _chi2_sql(column: str, table: str = "t") -> str:
    """A query of ``statistic, dof`` and the p-value: 1 less the power series of the lower incomplete gamma function."""
    cells = f"(SELECT {column} AS c, count(*) FILTER (late = 0) AS a, count(*) FILTER (late = 1) AS b FROM {table} GROUP BY 1)"
    sums = f"(SELECT sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb, count(*) AS k FROM {cells})"
    both = (
        f"SELECT k, a AS o, (a + b) * na / (na + nb) AS e FROM {cells}, {sums} UNION ALL SELECT k, b, (a + b) * nb / (na + "
        f"nb) FROM {cells}, {sums}"
    )
    off = "CASE WHEN k = 2 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END"
    total = f"(SELECT sum(off * off / e) AS x, max(k) - 1 AS dof FROM (SELECT k, e, {off} AS off FROM ({both})))"
    # Terms under 1e-300 are left out; x / 2 has its largest terms around n = x / 2 - dof / 2.
    power = "list_sum([exp(greatest(-x / 2 + (dof / 2 + n) * ln(x / 2) - lgamma(dof / 2 + n + 1), -690)) for n in range(0, 4000)])"
    return f"SELECT round(x, 6) AS statistic, dof, round(CASE WHEN x > 0 THEN greatest(0, 1 - {power}) ELSE 1 END, 6) AS p_value FROM {total}"


add(
    "ks_two_sample",
    lambda s, d: rounded(metrics.ks_two_sample(_drift(s, d), "late", "l_extendedprice")),
    f"{DRIFT} {_ks_sql('l_extendedprice')}",
)
for _c in ("l_returnflag", "l_linestatus"):
    add(
        "chi2_" + _c[2:],
        lambda s, d, c=_c: rounded(metrics.chi2_contingency(_drift(s, d), "late", c)),
        f"{DRIFT} SELECT statistic, dof FROM ({_chi2_sql(_c)})",
    )


def _columns(s: SparkSession, d: str) -> DataFrame:
    """Lines with categories of 2, 3, 4, 5, 7 and 1,999 values, most of which don't depend on the time."""
    keys = {"seven": F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))}
    keys |= {name: F.concat(F.lit("k"), (F.col("l_partkey") % n).cast("string")) for name, n in PART_KEYS.items()}
    return _drift(s, d).withColumns(keys)


PART_KEYS = {"two": 2, "four": 4, "five": 5, "many": 1999}
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "seven", *PART_KEYS]
DRIFT_COLUMNS = DRIFT + ", u AS (SELECT *, 'c' || l_linenumber AS seven, " + ", ".join(f"'k' || (l_partkey % {n}) AS {name}" for name, n in PART_KEYS.items()) + " FROM t)"
for _name, _level in (("drift_report", 0.05), ("shift_report", 0.1)):
    _parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{'ks' if k < 3 else 'chi2'}' AS test, p_value FROM ({_ks_sql(c, 'u') if k < 3 else _chi2_sql(c, 'u')})" for k, c in enumerate(COLUMNS))
    add(
        _name,
        lambda s, d, t=_level: rounded(metrics.drift_report(_columns(s, d), "late", COLUMNS, t)),
        f"{DRIFT_COLUMNS} SELECT *, p_value < {_level} AS drift FROM ({_parts})",
    )
