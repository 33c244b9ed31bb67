"""Ordering without a single-task window: row positions, halo chunks and blocked recurrences.

Series are tables with ``sym`` and ``ts`` (unique within a symbol). One symbol may hold all rows, so nothing here
partitions by symbol alone where it orders raw rows: work is cut into days, or into chunks of row positions.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a chunk.
CHUNK = 4096
#: Rows of a block of a recurrence, and the weight under which an earlier block no longer counts.
BLOCK, LEAST_WEIGHT = 256, 1e-18
#: Blocks that meet in one task to hand on their ends, at least.
SUPER = 256


def row_position(df: DataFrame, bucket: str = "day") -> DataFrame:
    """Adds ``rn``, the 0-based position in time order within the symbol. Rows are counted per ``bucket`` of time
    (combined before the shuffle), the counts are summed over those few rows, and only rows of one bucket are ordered: a day of
    a symbol's bars; for ticks, of which a day may be too much for a task, an hour or a minute."""
    day = df.withColumn("__day", F.date_trunc(bucket, "ts").cast("string"))
    counts = day.groupBy("sym", "__day").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("sym").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sym", "__day", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("sym", "__day").orderBy("ts")
    numbered = day.withColumn("__n", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["sym", "__day"]).withColumn("rn", F.col("__off") + F.col("__n")).drop("__day", "__off", "__n")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a time column with or without time zone, in whose order clocks are never set back."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        day, hour, minute = F.unix_date(F.col(column).cast("date")).cast("long"), F.hour(column), F.minute(column)
        second = F.extract(F.lit("SECOND"), F.col(column)) * 1_000_000
        return ((day * 24 + hour) * 60 + minute) * 60_000_000 + second.cast("long")
    return F.unix_micros(column)


def even_ranges(df: DataFrame, rows: int = CHUNK) -> DataFrame:
    """Adds ``__range`` and ``__start``: ranges of time of about ``rows`` rows each (at most twice as many where ``ts`` is
    unique within the symbol), numbered in the order of time, and the rows of the symbol before the range.

    Rows are counted by second (combined before the shuffle), and those of seconds of more than ``rows`` by microsecond.
    Prefix sums of the counts, whose quotients by ``rows`` are the ranges, are taken over the microseconds of such a second,
    the seconds of a day, and the days, so no window orders more than a million counts, however the rows lie. Rows without
    ``sym`` or ``ts`` have no place and are dropped, an empty table stays empty."""
    at = df.dropna(subset=["sym", "ts"]).withColumn("__m", micros(df, "ts")).withColumn("__s", F.col("__m") - F.pmod("__m", F.lit(1_000_000)))
    seconds = cut(at.groupBy("sym", "__s").agg(F.count(F.lit(1)).alias("c")))
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seconds = seconds.withColumn("__day", F.col("__s") - F.pmod("__s", F.lit(86_400_000_000)))
    days = seconds.groupBy("sym", "__day").agg(F.sum("c").alias("n")).select("sym", "__day", before("n", "sym", "__day").alias("of_day"))
    seconds = seconds.withColumn("of_second", before("c", "sym", "__day", "__s")).join(days, ["sym", "__day"])
    seconds = cut(seconds.select("sym", "__s", "c", (F.col("of_day") + F.col("of_second")).alias("p")))
    heavy = seconds.where(F.col("c") > rows).select("sym", "__s", F.col("p").alias("of_heavy"))
    inside = F.col("__m") - F.col("__s")
    fine = at.join(heavy, ["sym", "__s"]).groupBy("sym", "__s", "of_heavy", inside.alias("__u")).agg(F.count(F.lit(1)).alias("c"))
    fine = fine.select("sym", "__s", "__u", (F.col("of_heavy") + before("c", "sym", "__s", "__u")).alias("p"))
    light = seconds.where(F.col("c") <= rows).select("sym", "__s", F.lit(0).cast("long").alias("__u"), "p")
    cells = light.unionByName(fine).withColumn("__range", F.floor(F.col("p") / rows))
    starts = cells.groupBy("sym", "__range").agg(F.min("p").alias("__start"))
    cells = cut(cells.join(starts, ["sym", "__range"]).drop("p"))
    marked = at.join(heavy.select("sym", "__s", F.lit(True).alias("__heavy")), ["sym", "__s"], "left")
    keyed = marked.withColumn("__u", F.when(F.col("__heavy"), inside).otherwise(F.lit(0)).cast("long"))
    return keyed.join(cells, ["sym", "__s", "__u"]).select(*df.columns, "__range", "__start")


def even_position(df: DataFrame, rows: int = CHUNK) -> DataFrame:
    """Adds ``rn`` as :func:`row_position` does, for ticks of any density: rows are ordered in :func:`even_ranges`."""
    inside = Window.partitionBy("sym", "__range").orderBy("ts")
    return even_ranges(df, rows).withColumn("rn", F.col("__start") + F.row_number().over(inside) - 1).drop("__range", "__start")


def chunk_windows(df: DataFrame, back: int, ahead: int, build, chunk: int = CHUNK) -> DataFrame:
    """``build(frame, over)`` on chunks of row positions: rows within ``back`` before or ``ahead`` after a chunk are
    copied into it, so every frame of that reach is complete, and the copies are dropped afterwards. ``over(a, b)`` is
    the window of rows a to b in time order. ``df`` has ``rn``."""
    home = F.floor(F.col("rn") / chunk)
    low, high = F.floor((F.col("rn") - ahead) / chunk), F.floor((F.col("rn") + back) / chunk)
    spread = df.withColumn("__home", home).withColumn("__chunk", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    over = lambda a, b: Window.partitionBy("sym", "__chunk").orderBy("rn").rowsBetween(a, b)
    return build(spread, over).where("__chunk = __home").drop("__chunk", "__home")


def full(value: Column, counted: Column, n: int) -> Column:
    """The value where its window holds ``n`` values, null elsewhere."""
    return F.when(counted == n, value)


def _weighing(weight: float) -> Callable[[Column, Column], Column]:
    return lambda acc, e: acc * F.lit(weight) + e


def recurrences(df: DataFrame, means: dict[str, tuple[str, float]], block: int = BLOCK) -> DataFrame:
    """Adds a column for each of ``means`` (name: source and alpha) with y0 = x0 and y = (1 - alpha) * y_before + alpha * x
    in the order of ``rn``, for rows from 0 on without nulls in the sources.

    Blocks of ``block`` rows, which carry all columns, are scanned once for all means, each from 0; the blocks' ends are then
    carried into the later ones with weights that fall by (1 - alpha)^block a block, over as many blocks as still count.
    Blocks meet for that in runs of SUPER, to which the ends of the last blocks before them are copied. Rows come back out
    of the blocks: nothing is joined, and ``df`` stands in the plan once, however many recurrences are chained."""
    rest = [c for c in df.columns if c not in ("sym", "rn")]
    blocked = df.withColumn("__b", F.floor(F.col("rn") / block))
    pairs = blocked.groupBy("sym", "__b").agg(F.sort_array(F.collect_list(F.struct("rn", *rest))).alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        now = [F.when(r["rn"] == 0, r[x]).otherwise(acc[y] * (1.0 - alpha) + r[x] * alpha).alias(y) for y, (x, alpha) in means.items()]
        return F.struct(*now, F.concat(acc["all"], F.array(F.struct(*now))).alias("all"))

    kind = "array<struct<" + ",".join(f"`{y}`:double" for y in means) + ">>"
    start = F.struct(*[F.lit(0.0).alias(y) for y in means], F.array().cast(kind).alias("all"))
    local = pairs.withColumn("ys", F.aggregate("rows", start, step, lambda acc: acc["all"]))
    reaches = {}
    for y, (_, alpha) in means.items():
        weight, reaches[y] = (1.0 - alpha) ** block, 1
        while weight > 0 and weight ** reaches[y] > LEAST_WEIGHT:
            reaches[y] += 1
    # A run is longer than what its blocks look back on, so each block is copied to the next run at most.
    run = max(SUPER, max(reaches.values()) + 1)
    own = F.floor(F.col("__b") / run)
    near = F.pmod("__b", F.lit(run)) >= run - max(reaches.values())
    homes = F.when(near, F.array(own, own + 1)).otherwise(F.array(own))
    spread = local.select("sym", "__b", "rows", "ys", F.element_at("ys", -1).alias("end"), F.posexplode(homes).alias("__copy", "__run"))
    spread = spread.withColumns({c: F.when(F.col("__copy") == 0, F.col(c)) for c in ("rows", "ys")})
    carried = []
    for k, (y, (_, alpha)) in enumerate(means.items()):
        before = Window.partitionBy("sym", "__run").orderBy("__b").rowsBetween(-reaches[y], -1)
        carried.append(F.aggregate(F.collect_list(F.col("end")[y]).over(before), F.lit(0.0), _weighing((1.0 - alpha) ** block)).alias(f"__c{k}"))
    rows = spread.select("sym", "__b", "__copy", "rows", "ys", *carried).where("__copy = 0")
    rows = rows.select("sym", "__b", *[f"__c{k}" for k in range(len(means))], F.explode(F.arrays_zip("rows", "ys")).alias("z"))
    since = F.col("z.rows.rn") - F.col("__b") * block + 1
    out = [(F.col("z.ys")[y] + F.col(f"__c{k}") * F.pow(F.lit(1.0 - alpha), since)).alias(y) for k, (y, (_, alpha)) in enumerate(means.items())]
    return rows.select(*[F.col("sym") if c == "sym" else F.col("z.rows")[c].alias(c) for c in df.columns if c not in means], *out)


def recurrence(df: DataFrame, x: str, out: str, alpha: float, block: int = BLOCK) -> DataFrame:
    """One mean of :func:`recurrences`."""
    return recurrences(df, {out: (x, alpha)}, block)


#: How running aggregates join what comes before a bucket with what is inside it.
JOIN_SUM = lambda before, inside: F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
JOIN_PRODUCT = lambda before, inside: F.coalesce(before, F.lit(1.0)) * F.coalesce(inside, F.lit(1.0))
JOIN_MAX = lambda before, inside: F.greatest(before, inside)


def running(df: DataFrame, column: str, out: str, aggregate=F.sum, join=JOIN_SUM, upto: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Adds ``out``: the aggregate of ``column`` over the symbol's rows up to this one (``upto`` 0) or the one before
    (-1), in the order of ``rn``. Chunks of positions are aggregated on their own; only their totals are ordered by symbol."""
    b = df.withColumn("__b", F.floor(F.col("rn") / chunk))
    inside = Window.partitionBy("sym", "__b").orderBy("rn").rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy("sym").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy("sym", "__b").agg(aggregate(column).alias("__t"))
    starts = totals.select("sym", "__b", aggregate("__t").over(before).alias("__s"))
    both = b.withColumn("__v", aggregate(column).over(inside)).join(starts, ["sym", "__b"])
    return both.withColumn(out, join(F.col("__s"), F.col("__v"))).drop("__b", "__s", "__v")


def carry(df: DataFrame, columns: list[str], suffix: str, ahead: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Adds ``<column><suffix>``: the last value at or before each row that isn't null, or the first at or after it
    (``ahead``), in the order of ``rn``. Within a chunk one ordered pass; across chunks one summary row a chunk."""
    return carry_sides(df, columns, {suffix: ahead}, chunk)


def carry_sides(df: DataFrame, columns: list[str], sides: dict[str, bool], chunk: int = CHUNK) -> DataFrame:
    """:func:`carry` for each of ``sides`` (suffix: whether ahead) at once, with one shuffle of the rows. Looking ahead is
    looking back in descending order: a frame that only grows is one step a row, one that shrinks is summed anew at each."""
    b = df.withColumn("__b", F.floor(F.col("rn") / chunk))
    wanted = [(f"{k}{suffix}", c, c + suffix, ahead) for suffix, ahead in sides.items() for k, c in enumerate(columns)]
    order = lambda by, ahead: F.desc(by) if ahead else F.asc(by)
    inside = lambda ahead: Window.partitionBy("sym", "__b").orderBy(order("rn", ahead)).rowsBetween(Window.unboundedPreceding, 0)
    across = lambda ahead: Window.partitionBy("sym").orderBy(order("__b", ahead)).rowsBetween(Window.unboundedPreceding, -1)
    ends = b.groupBy("sym", "__b").agg(*[(F.min_by if ahead else F.max_by)(c, F.when(F.col(c).isNotNull(), F.col("rn"))).alias(f"__e{k}") for k, c, _, ahead in wanted])
    outside = ends.select("sym", "__b", *[F.last(f"__e{k}", ignorenulls=True).over(across(ahead)).alias(f"__o{k}") for k, _, _, ahead in wanted])
    found = b.select("*", *[F.last(c, ignorenulls=True).over(inside(ahead)).alias(f"__i{k}") for k, c, _, ahead in wanted]).join(outside, ["sym", "__b"])
    return found.select(*df.columns, *[F.coalesce(f"__i{k}", f"__o{k}").alias(name) for k, _, name, _ in wanted])


def lagged(df: DataFrame, columns: list[str], suffix: str = "_prev") -> DataFrame:
    """Adds the value of the row before as ``<column><suffix>``."""
    return chunk_windows(df, 1, 0, lambda b, over: b.select("*", *[F.max(c).over(over(-1, -1)).alias(c + suffix) for c in columns]))


def pct_change(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the relative change from the row before; null in a symbol's first row and after a 0."""
    b = lagged(df if "rn" in df.columns else row_position(df), [column], "__before")
    return b.withColumn(out, F.try_divide(F.col(column), F.col(f"{column}__before")) - 1).drop(f"{column}__before")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a session in one process (as in tests) gets a
    temporary folder; on a cluster, whose executors would not see that, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint under :func:`scratch_root`."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        root = scratch_root(df.sparkSession)
        if df.sparkSession.sparkContext.getCheckpointDir() is None:
            df.sparkSession.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def grouped_quantiles(df: DataFrame, by: list[str], columns: list[str], shares: list[float], accuracy: int = 2000) -> DataFrame:
    """``*by, column, share, value``: the exact quantiles, interpolated between neighbours, of the non-null values of each of
    ``columns`` in each group of ``by``; a group without values has no row.

    Two scans, however many groups, columns and shares there are. The first has approximate quantiles a little to either side of each,
    the second counts what is below and the distinct values between, of which the wanted places are read off. Should a bracket
    miss its place, all are widened and counted again. No task holds more than a bracket's share of a group's distinct values."""
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(*by, F.inline(values)).where("x is not null")
    keys, margin = [*by, "column"], 3 / accuracy
    while True:
        ends = [F.lit(min(max(p + side * margin, 0.0), 1.0)) for p in shares for side in (-1, 1)]
        found = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", F.array(*ends), F.lit(accuracy)).alias("e"))
        marks = F.array(*[F.struct(F.lit(p).alias("share"), (p * (F.col("n") - 1)).alias("place"), F.get("e", F.lit(2 * k)).alias("low"), F.get("e", F.lit(2 * k + 1)).alias("high")) for k, p in enumerate(shares)])
        marked = cut(found.select(*keys, marks.alias("marks")))
        same = [long[k].eqNullSafe(marked[k]) for k in keys]
        seen = long.join(marked, reduce(lambda a, b: a & b, same)).select(*[long[k] for k in keys], "x", F.posexplode("marks").alias("k", "m"))
        # Below the bracket a row counts without its value, beyond it not at all.
        seen = seen.where("x <= m.high").select(*keys, "k", "m.share", "m.place", F.when(F.col("x") >= F.col("m.low"), F.col("x")).alias("x"))
        counts = seen.groupBy(*keys, "k", "share", "place", "x").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "k").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0))
        ranked = counts.withColumn("upto", upto)
        at = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col("x")))
        low, high = at(F.floor("place")), at(F.ceil("place"))
        out = cut(ranked.groupBy(*keys, "share", "place").agg(low.alias("low"), high.alias("high")))
        if margin >= 1 or out.where("low is null or high is null").isEmpty():
            return out.select(*keys, "share", (F.col("low") + (F.col("place") - F.floor("place")) * (F.col("high") - F.col("low"))).alias("value"))
        margin *= 8
