"""Queries of reading, cleaning, joins and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import cleaning as cl
from tidemill.operators.bars import ticks
from tidemill.operators.core import even_position, pct_change, row_position
from tidemill.plans.queries import BARS, DIGITS, add, bars, shown, table

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
HOLE = "(day(ts) * 24 + hour(ts)) % 17 = 0"
#: Bars with holes: ``x`` is close, null in one hour of 17.
HOLES = f"{BARS}, d AS (SELECT *, CASE WHEN NOT {HOLE} THEN close END AS x FROM bars)"
UP, AHEAD = "(PARTITION BY sym ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(PARTITION BY sym ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
BEFORE, AFTER = f"last_value(x IGNORE NULLS) OVER {UP}", f"first_value(x IGNORE NULLS) OVER {AHEAD}"


def positioned(s: SparkSession, d: str) -> DataFrame:
    return row_position(bars(s, d))


def holes(s: SparkSession, d: str) -> DataFrame:
    return positioned(s, d).withColumn("x", F.when(~F.expr(HOLE), F.col("close")))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _texts(s: SparkSession, d: str) -> DataFrame:
    t = even_position(ticks(table(s, d, "events")))
    return t.withColumn("x", F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("price").cast("string")))


TEXTS = (
    "WITH t AS (SELECT event_type AS sym, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS rn, "
    "CASE WHEN event_id % 13 <> 0 THEN value END AS x FROM events)"
)
add(
    "tick_position",
    lambda s, d: even_position(ticks(table(s, d, "events"))).select("sym", "event_id", "rn"),
    "SELECT event_type AS sym, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS rn FROM events",
)
add(
    "coerce_numeric",
    lambda s, d: rounded(cl.fill(cl.coerce_numeric(_texts(s, d), ["x"]), ["x"]).select("sym", "event_id", "x")),
    f"{TEXTS} SELECT sym, event_id, round(coalesce({BEFORE}, {AFTER}), 6) AS x FROM t",
)
add(
    "coerce_report",
    lambda s, d: cl.coerce_report(_texts(s, d), ["x"]),
    "SELECT 'x' AS \"column\", count(*) FILTER (event_id % 13 = 0) AS offenders, max(CASE WHEN event_id % 13 = 0 THEN 'n/a' END) AS example FROM events",
)
add(
    "epoch_ms_to_ts",
    lambda s, d: table(s, d, "orders").select("o_orderkey", cl.millis_text(F.col("o_orderkey") * 86400123).alias("at")),
    "SELECT o_orderkey, strftime(epoch_ms(o_orderkey * 86400123), '%Y-%m-%d %H:%M:%S.%g') AS at FROM orders",
)
add(
    "rename_columns",
    lambda s, d: shown(bars(s, d).withColumnsRenamed({"close": "last_price", "absent": "other"}), "last_price"),
    f"{BARS} SELECT sym, {TS}, round(close, 6) AS last_price FROM bars",
)
add(
    "drop_null_rows",
    lambda s, d: shown(holes(s, d).dropna(subset=["x"]), "x"),
    f"{HOLES} SELECT sym, {TS}, round(x, 6) AS x FROM d WHERE x IS NOT NULL",
)
add(
    "warmup_drop_null",
    lambda s, d: shown(cl.drop_after_warmup(holes(s, d), ["x"]), "rn", "x"),
    f"{HOLES} SELECT sym, {TS}, rn, round(x, 6) AS x FROM d WHERE rn < 50 OR x IS NOT NULL",
)
add("fill_zero", lambda s, d: shown(holes(s, d).fillna(0, ["x"]), "x"), f"{HOLES} SELECT sym, {TS}, round(coalesce(x, 0), 6) AS x FROM d")
add(
    "dedup_rows",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").dropDuplicates(),
    "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem",
)
add(
    "dedup_keep_first",
    lambda s, d: cl.keep_one(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value"),
    "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value "
    "FROM events GROUP BY 1, 2",
)
add(
    "ffill_bfill",
    lambda s, d: shown(cl.fill(holes(s, d), ["x"]), "x"),
    f"{HOLES} SELECT sym, {TS}, round(coalesce({BEFORE}, {AFTER}), 6) AS x FROM d",
)
add(
    "bfill_ffill",
    lambda s, d: shown(cl.fill(holes(s, d), ["x"], backward_first=True), "x"),
    f"{HOLES} SELECT sym, {TS}, round(coalesce({AFTER}, {BEFORE}), 6) AS x FROM d",
)
add(
    "preprocess",
    lambda s, d: shown(cl.preprocess(bars(s, d).unionByName(bars(s, d)).withColumn("x", F.when(~F.expr(HOLE), F.col("close"))), ["x"]), "x"),
    f"{HOLES} SELECT sym, {TS}, round(coalesce({BEFORE}, {AFTER}), 6) AS x FROM d",
)


def _line(source: str) -> str:
    at = [f"{f}(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER {w}" for f, w in (("last_value", UP), ("first_value", AHEAD))]
    return (
        f", l AS (SELECT *, {BEFORE} AS xb, {AFTER} AS xa, {at[0]} AS rb, {at[1]} AS ra FROM {source}) SELECT sym, {TS}, "
        "round(coalesce(x, xb + (xa - xb) * (rn - rb) / (ra - rb), xb, xa), 6) AS x FROM l"
    )


add("interpolate_linear", lambda s, d: shown(cl.interpolate_linear(holes(s, d), "x"), "x"), HOLES + _line("d"))
add(
    "smooth_outliers",
    lambda s, d: shown(cl.smooth_outliers(positioned(s, d).withColumn("x", F.col("close")), "x", 2.0), "x"),
    f"{BARS}, z AS (SELECT sym, avg(close) AS m, stddev_samp(close) AS sd FROM bars GROUP BY sym), d AS (SELECT bars.*, CASE WHEN abs((close - m) / (sd + 1e-9)) <= 2.0 THEN close END AS x FROM bars JOIN z USING (sym))" + _line("d"),
)
GRID = "g AS (SELECT sym, unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts FROM bars GROUP BY sym)"
add(
    "calendar_reindex",
    lambda s, d: shown(cl.calendar_reindex(bars(s, d), "1 hour"), "close"),
    f"{BARS}, {GRID.format(step='1 HOUR')} SELECT g.sym, strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(close, 6) AS "
    "close FROM g LEFT JOIN bars ON g.sym = bars.sym AND g.ts = bars.ts",
)
add(
    "standardize_sampling",
    lambda s, d: shown(cl.standardize_sampling(bars(s, d), ["close"], "30 minutes"), "close"),
    f"{BARS}, {GRID.format(step='30 MINUTES')} SELECT g.sym, strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(close, 6) "
    "AS close FROM g ASOF JOIN bars ON g.sym = bars.sym AND g.ts >= bars.ts",
)
MARKS = f"""{BARS}, y AS (SELECT *, abs(close - lag(close) OVER w) AS dd, date_diff('second', lag(ts) OVER w, ts) AS delta_s FROM bars WINDOW w AS (PARTITION BY sym ORDER BY rn)),
z AS (SELECT sym, stddev_samp(dd) AS sd, median(delta_s) FILTER (delta_s > 0) AS med FROM y GROUP BY sym),
m AS (SELECT y.*, (coalesce(dd > 3.0 * sd, false))::INTEGER AS spike, (close <= 0)::INTEGER AS nonpositive, (coalesce(delta_s > 1.5 * med, false))::INTEGER AS gap FROM y JOIN z USING (sym))"""


def _marked(s: SparkSession, d: str) -> DataFrame:
    return cl.mark_anomalies(positioned(s, d), spread=3.0, gap=1.5)


add(
    "price_spikes",
    lambda s, d: shown(_marked(s, d).where("spike = 1"), "close"),
    f"{MARKS} SELECT sym, {TS}, round(close, 6) AS close FROM m WHERE spike = 1",
)
add(
    "nonpositive_prices",
    lambda s, d: shown(cl.mark_anomalies(positioned(s, d).withColumn("x", F.col("close") - 40), "x").where("nonpositive = 1"), "x"),
    f"{BARS} SELECT sym, {TS}, round(close - 40, 6) AS x FROM bars WHERE close - 40 <= 0",
)
add("time_gaps", lambda s, d: shown(_marked(s, d).where("gap = 1"), "delta_s"), f"{MARKS} SELECT sym, {TS}, delta_s FROM m WHERE gap = 1")
add(
    "anomaly_summary",
    lambda s, d: cl.anomaly_summary(_marked(s, d)),
    f"{MARKS} SELECT sym, sum(spike)::BIGINT AS spikes, sum(nonpositive)::BIGINT AS nonpositive, sum(gap)::BIGINT AS "
    "gaps, max(delta_s) AS max_delta_s, median(delta_s) FILTER (delta_s > 0) AS median_delta_s FROM m GROUP BY sym",
)
add(
    "coerce_offenders",
    lambda s, d: cl.coerce_offenders(table(s, d, "documents"), ["source", "lang"], "doc_id"),
    "WITH b AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", doc_id AS place, {c} AS value FROM documents WHERE {c} IS NOT NULL AND try_cast({c} AS DOUBLE) IS NULL" for c in ("source", "lang")) + ") SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY place, value) <= 5",
)
add(
    "validate_bars",
    lambda s, d: cl.validate_bars(holes(s, d), ["open", "x", "absent"], ["close"]),
    f"{HOLES} SELECT 'absent' AS missing_columns, count(*) FILTER (x IS NULL OR open IS NULL) AS rows_with_nulls, "
    "count(*) FILTER (close <= 0) AS rows_not_positive FROM d",
)
add(
    "rows_any_missing",
    lambda s, d: cl.rows_any_missing(holes(s, d), ["x", "close"]),
    f"{HOLES} SELECT count(*) FILTER (x IS NULL OR close IS NULL) AS row_count, count(*) FILTER (x IS NULL) + count(*) "
    "FILTER (close IS NULL) AS total FROM d",
)


def _shuffled(s: SparkSession, d: str) -> DataFrame:
    """Bars in the order of a hash of their place: of 1,009 values, each of which is counted and ordered apart."""
    rows = row_position(bars(s, d)).withColumn("k", F.pmod(F.col("rn") * 7919, F.lit(1009)))
    counts = rows.groupBy("sym", "k").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("sym").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("sym", "k", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("sym", "k").orderBy("rn")) - 1
    return rows.withColumn("i", inside).join(starts, ["sym", "k"]).withColumn("rn", F.col("start") + F.col("i")).drop("k", "i", "start")


SHUFFLED = (
    f"{BARS}, h AS (SELECT sym, ts, row_number() OVER (PARTITION BY sym ORDER BY rn * 7919 % 1009, rn) AS k FROM bars), l "
    "AS (SELECT sym, ts, lag(ts) OVER (PARTITION BY sym ORDER BY k) AS p FROM h)"
)
add(
    "steps_back",
    lambda s, d: cl.steps_back(_shuffled(s, d)),
    f"{SHUFFLED} SELECT sym, count(*) FILTER (ts < p) AS steps_back FROM l GROUP BY sym",
)
add(
    "sort_time",
    lambda s, d: shown(row_position(_shuffled(s, d).drop("rn")), "rn", "close"),
    f"{BARS} SELECT sym, {TS}, rn, round(close, 6) AS close FROM bars",
)
add(
    "head_sample",
    lambda s, d: cl.head_rows(table(s, d, "events"), 1000, ["ts", "event_id"]).select("event_id", "value"),
    "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 1000",
)


add(
    "tail_n",
    lambda s, d: shown(cl.tail_rows(positioned(s, d), 50), "close"),
    f"{BARS} SELECT sym, {TS}, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY sym ORDER BY rn "
    "DESC) <= 50",
)


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Bars, and predictions for those in the first 20 hours of a day with some more a year later."""
    b = bars(s, d).select("sym", "ts", "close")
    p = b.where("hour(ts) < 20").select(
        "sym", F.expr("if(hour(ts) = 3, ts + interval 365 days, ts)").alias("ts"), (F.col("close") / 1000).alias("prob"),
    )
    return b, p


SIDES = (
    f"{BARS}, p AS (SELECT sym, CASE WHEN hour(ts) = 3 THEN ts + INTERVAL 365 DAYS ELSE ts END AS ts, close / 1000 AS "
    "prob FROM bars WHERE hour(ts) < 20)"
)


def _joined(how: str, *columns: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        b, p = _sides(s, d)
        return shown(b.join(p, ["sym", "ts"], how), *columns)

    return run


add(
    "align_inner",
    _joined("inner", "close", "prob"),
    f"{SIDES} SELECT sym, {TS}, round(close, 6) AS close, round(prob, 6) AS prob FROM bars JOIN p USING (sym, ts)",
)
add(
    "left_reindex",
    _joined("left", "close", "prob"),
    f"{SIDES} SELECT sym, {TS}, round(close, 6) AS close, round(prob, 6) AS prob FROM bars LEFT JOIN p USING (sym, ts)",
)
add(
    "pad_predictions",
    lambda s, d: shown(cl.pad_predictions(*_sides(s, d)), "prob"),
    f"{SIDES} SELECT sym, {TS}, round(coalesce(prob, 0.5), 6) AS prob FROM bars LEFT JOIN p USING (sym, ts)",
)
add(
    "outer_align_models",
    _joined("full", "close", "prob"),
    f"{SIDES} SELECT sym, {TS}, round(close, 6) AS close, round(prob, 6) AS prob FROM bars FULL JOIN p USING (sym, ts)",
)


add(
    "align_report",
    lambda s, d: cl.align_report(*_sides(s, d), ["sym", "ts"]),
    f"{SIDES} SELECT count(*) FILTER (close IS NOT NULL AND prob IS NOT NULL) AS matched, count(*) FILTER (prob IS NULL) "
    "AS only_left, count(*) FILTER (close IS NULL) AS only_right FROM bars FULL JOIN p USING (sym, ts)",
)
add(
    "intersect_keys",
    lambda s, d: shown(_sides(s, d)[0].select("sym", "ts").intersect(_sides(s, d)[1].select("sym", "ts"))),
    f"{SIDES} SELECT sym, {TS} FROM (SELECT sym, ts FROM bars INTERSECT SELECT sym, ts FROM p)",
)
add(
    "union_categories",
    lambda s, d: table(s, d, "lineitem").select(F.col("l_returnflag").alias("c")).union(table(s, d, "lineitem").select("l_linestatus")).distinct(),
    "SELECT l_returnflag AS c FROM lineitem UNION SELECT l_linestatus FROM lineitem",
)


def _union(s: SparkSession, d: str) -> DataFrame:
    """Bars with newer rows for some of their hours; the newer ones win."""
    old, new = bars(s, d), bars(s, d).where("hour(ts) = 5").withColumn("close", F.col("close") + 1)
    return cl.union_newer(old, new, ["sym", "ts"])


add(
    "union_bars",
    lambda s, d: shown(_union(s, d), "close"),
    f"{BARS} SELECT sym, {TS}, round(CASE WHEN hour(ts) = 5 THEN close + 1 ELSE close END, 6) AS close FROM bars",
)
add(
    "pct_change",
    lambda s, d: shown(pct_change(positioned(s, d), "close", "change"), "change"),
    f"{BARS} SELECT sym, {TS}, round(close / lag(close) OVER (PARTITION BY sym ORDER BY rn) - 1, 6) AS change FROM bars",
)
add(
    "select_existing",
    lambda s, d: shown(cl.select_existing(bars(s, d), ["close", "absent", "volume"]), "close", "volume"),
    f"{BARS} SELECT sym, {TS}, round(close, 6) AS close, round(volume, 6) AS volume FROM bars",
)
add(
    "prefix_columns",
    lambda s, d: shown(cl.prefix_columns(bars(s, d), "1h"), "1h_open", "1h_close"),
    f'{BARS} SELECT sym, {TS}, round(open, 6) AS "1h_open", round(close, 6) AS "1h_close" FROM bars',
)
