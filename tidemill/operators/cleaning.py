"""Reading values, filling, regular grids and anomalies of series with ``sym``, ``ts`` and the position ``rn``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.bars import asof_backward
from tidemill.operators.core import carry_sides, cut, grouped_quantiles, lagged, row_position


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as doubles; what isn't a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def millis_text(ms: Column) -> Column:
    """Milliseconds since 1970 as ``yyyy-MM-dd HH:mm:ss.SSS`` in UTC, whatever the session's time zone. Whole numbers all the
    way, so no digit is lost; a year after 9999 has more digits and no sign, one before 0 isn't padded."""
    at = F.timestamp_add("MILLISECOND", ms, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    year = F.when(F.year(at) < 0, F.year(at).cast("string")).when(F.year(at) >= 0, F.format_string("%04d", F.year(at)))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.hour(at)), two(F.minute(at)), two(F.second(at)))
    return F.concat(year, F.lit("-"), two(F.month(at)), F.lit("-"), two(F.dayofmonth(at)), F.lit(" "), clock, F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))


def coerce_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, offenders, example`` in one pass: values that aren't numbers, and the smallest of them."""
    bad = {c: F.col(c).isNotNull() & F.col(c).try_cast("double").isNull() for c in columns}
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(b).alias("offenders"), F.min(F.when(b, F.col(c))).alias("example")).alias(c) for c, b in bad.items()])
    return one.select(F.inline(F.array(*columns)))


def coerce_offenders(df: DataFrame, columns: list[str], place: str, n: int = 5) -> DataFrame:
    """``column, place, value``: the first ``n`` values of each column, in the order of ``place``, that aren't numbers. Each
    task keeps its first ones before anything is shuffled."""
    bad = [F.struct(F.lit(c).alias("column"), F.col(place).alias("place"), F.when(F.col(c).try_cast("double").isNull(), F.col(c)).cast("string").alias("value")) for c in columns]
    each = df.select(F.inline(F.array(*bad))).where("value is not null")
    first = F.row_number().over(Window.partitionBy("column").orderBy("place", "value"))
    return each.withColumn("__k", first).where(F.col("__k") <= n).drop("__k")


def fill(df: DataFrame, columns: list[str], backward_first: bool = False) -> DataFrame:
    """Nulls filled by the last value before and, where there is none, the first after; the other way round with
    ``backward_first``. A column without values stays null."""
    both = carry_sides(df, columns, {"__f": False, "__n": True})
    sides = ("__n", "__f") if backward_first else ("__f", "__n")
    return both.withColumns({c: F.coalesce(c, c + sides[0], c + sides[1]) for c in columns}).select(*df.columns)


def interpolate_linear(df: DataFrame, column: str) -> DataFrame:
    """Nulls between two values lie on the line between them by row position; leading and trailing ones take the nearest."""
    point = df.withColumn("__p", F.when(F.col(column).isNotNull(), F.struct("rn", F.col(column).alias("v"))))
    p = carry_sides(point, ["__p"], {"f": False, "n": True})
    line = F.col("__pf.v") + (F.col("__pn.v") - F.col("__pf.v")) * (F.col("rn") - F.col("__pf.rn")) / (F.col("__pn.rn") - F.col("__pf.rn"))
    return p.withColumn(column, F.coalesce(column, line, "__pf.v", "__pn.v")).select(*df.columns)


def smooth_outliers(df: DataFrame, column: str, z: float = 4.0) -> DataFrame:
    """Values further than ``z`` sample deviations from the symbol's mean are replaced by interpolation."""
    stats = df.groupBy("sym").agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    far = F.abs((F.col(column) - F.col("__m")) / (F.col("__s") + 1e-9)) > z
    return interpolate_linear(
        df.join(stats, "sym").withColumn(column, F.when(F.coalesce(far, F.lit(False)), None).otherwise(F.col(column))).select(*df.columns),
        column,
    )


def drop_after_warmup(df: DataFrame, columns: list[str], warmup: int = 50) -> DataFrame:
    """The first ``warmup`` rows of a symbol and those later ones that have all ``columns``."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.where((F.col("rn") < warmup) | whole)


def calendar(df: DataFrame, step: str) -> DataFrame:
    """``sym, ts`` of every ``step`` (a part of a day) between a symbol's first and last row, made day by day."""
    ends = df.groupBy("sym").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    days = ends.select("*", F.explode(F.expr("sequence(to_date(lo), to_date(hi), interval 1 day)")).alias("day"))
    slots = days.select(
        "sym", "lo", "hi",
        F.explode(F.expr(f"sequence(cast(day as timestamp_ntz), cast(day as timestamp_ntz) + interval 1 day - interval {step}, interval {step})")).alias("ts"),
    )
    return slots.where("ts between lo and hi").select("sym", "ts")


def calendar_reindex(df: DataFrame, step: str) -> DataFrame:
    """The rows on a complete calendar, null where a slot has none."""
    return calendar(df, step).join(df, ["sym", "ts"], "left")


def standardize_sampling(df: DataFrame, columns: list[str], step: str) -> DataFrame:
    """The last observation at or before each slot of a regular grid."""
    return asof_backward(calendar(df, step), df, columns)


def mark_anomalies(df: DataFrame, column: str = "close", spread: float = 5.0, gap: float = 3.0) -> DataFrame:
    """Adds ``delta_s`` and 0/1 marks: ``spike`` where the absolute difference exceeds ``spread`` of its sample
    deviations, ``nonpositive``, and ``gap`` where the time since the row before exceeds ``gap`` medians of such times."""
    d = cut(lagged(df, [column, "ts"]).withColumn("__d", F.abs(F.col(column) - F.col(f"{column}_prev"))).withColumn(
        "delta_s", F.expr("timestampdiff(SECOND, ts_prev, ts)"),
    ))
    stats = d.groupBy("sym").agg(F.stddev_samp("__d").alias("__sd")).join(_median_step(d, "__med"), "sym", "left")
    mark = lambda c: F.when(c, 1).otherwise(0)
    m = d.join(stats, "sym").withColumns({"spike": mark(F.col("__d") > spread * F.col("__sd")), "nonpositive": mark(F.col(column) <= 0), "gap": mark(F.col("delta_s") > gap * F.col("__med"))})
    return m.drop("__d", "__sd", "__med", f"{column}_prev", "ts_prev")


def _median_step(d: DataFrame, out: str) -> DataFrame:
    """``sym`` and the exact median of the times between rows that are over 0."""
    return grouped_quantiles(d.where("delta_s > 0"), ["sym"], ["delta_s"], [0.5]).select("sym", F.col("value").alias(out))


def anomaly_summary(marked: DataFrame) -> DataFrame:
    """Counts of each kind by symbol, with the largest and the median time between rows."""
    counts = marked.groupBy("sym").agg(
        F.count_if(F.col("spike") == 1).alias("spikes"), F.count_if(F.col("nonpositive") == 1).alias("nonpositive"),
        F.count_if(F.col("gap") == 1).alias("gaps"), F.max("delta_s").alias("max_delta_s"),
    )
    return counts.join(_median_step(marked, "median_delta_s"), "sym", "left")


def align_checked(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both tables that match on ``keys``; without any it raises, with the counts of both sides."""
    found = left.join(right, keys)
    if found.isEmpty():
        report = align_report(left, right, keys).first()
        raise ValueError(f"no rows match on {', '.join(keys)}: {report.only_left} on the left, {report.only_right} on the right")
    return found


def preprocess(df: DataFrame, required: list[str]) -> DataFrame:
    """Raw rows made ready: of rows that repeat ``sym`` and ``ts`` one stays, columns are filled by the value before and then the one
    after, and rows that still lack one of ``required`` fall away."""
    one = keep_one(df, ["sym", "ts"], [c for c in df.columns if c not in ("sym", "ts")] or ["ts"])
    return fill(row_position(one), [c for c in required if c in df.columns]).dropna(subset=required).drop("rn")


def validate_bars(df: DataFrame, required: list[str], positive: list[str]) -> DataFrame:
    """One row: ``missing_columns`` (comma-joined), rows with nulls in required columns and rows with a price of 0 or less."""
    missing = [c for c in required if c not in df.columns]
    some, low = F.lit(False), F.lit(False)
    for c in set(required) - set(missing):
        some = some | F.col(c).isNull()
    for c in set(positive) - set(missing):
        low = low | F.coalesce(F.col(c) <= 0, F.lit(False))
    return df.agg(
        F.lit(",".join(missing)).alias("missing_columns"), F.count_if(some).alias("rows_with_nulls"),
        F.count_if(low).alias("rows_not_positive"),
    )


def keep_one(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """Of the rows with equal ``keys`` the first in the ``order``, or the last, with all columns; combined before the
    shuffle, so that a hot key moves one row a task."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*df.columns), F.struct(*order)).alias("__r")).select("__r.*")


def union_newer(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables, by name; where both have a key, the newer one's."""
    both = old.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, keys, ["__seq"], last=True).select(*old.columns)


def tail_rows(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each symbol by position."""
    return df.join(df.groupBy("sym").agg(F.max("rn").alias("__last")), "sym").where(F.col("rn") > F.col("__last") - n).drop("__last")


def head_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in the ``order``: each task keeps its first, and only those meet."""
    return df.orderBy(*order).limit(n)


def rows_any_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """``row_count, total``: rows that lack a value in any of ``columns``, and all values that are missing."""
    some, total = F.lit(False), F.lit(0).cast("long")
    for c in columns:
        some = some | F.col(c).isNull()
        total = total + F.count_if(F.col(c).isNull())
    return df.agg(F.count_if(some).alias("row_count"), total.alias("total"))


def align_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``matched, only_left, only_right``: rows of a full join on ``keys`` by the sides that have them."""
    j = left.select(*keys, F.lit(1).alias("__l")).join(right.select(*keys, F.lit(1).alias("__r")), keys, "full")
    has = lambda c: F.col(c).isNotNull()
    return j.agg(
        F.count_if(has("__l") & has("__r")).alias("matched"), F.count_if(has("__l") & ~has("__r")).alias("only_left"),
        F.count_if(~has("__l") & has("__r")).alias("only_right"),
    )


def pad_predictions(bars: DataFrame, predictions: DataFrame, value: float = 0.5) -> DataFrame:
    """Bars with their ``prob``, ``value`` where there is none."""
    return bars.join(predictions.select("sym", "ts", "prob"), ["sym", "ts"], "left").fillna(value, ["prob"])


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those of ``wanted`` that the table lacks."""
    return [c for c in wanted if c not in df.columns]


def select_existing(df: DataFrame, wanted: list[str], keys: tuple[str, ...] = ("sym", "ts")) -> DataFrame:
    """The keys and those of ``wanted`` that the table has, in the order asked for; :func:`missing_columns` names the rest."""
    return df.select(*[c for c in (*keys, *wanted) if c in df.columns])


def prefix_columns(df: DataFrame, prefix: str, keys: tuple[str, ...] = ("sym", "ts")) -> DataFrame:
    """All columns but the keys, named ``<prefix>_<column>``."""
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def steps_back(df: DataFrame, order: str = "ts") -> DataFrame:
    """``sym, steps_back``: rows whose time is before that of the row that stands before them (``rn``); 0 where sorted."""
    return lagged(df, [order]).groupBy("sym").agg(F.count_if(F.col(order) < F.col(f"{order}_prev")).alias("steps_back"))
