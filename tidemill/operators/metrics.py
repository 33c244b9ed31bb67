"""Performance, classification and distribution metrics as plain aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemill.operators.core import CHUNK, chunk_windows, cut, row_position


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 columns; a zero divisor gives 0."""
    tp, fp, fn = F.count_if((F.col(y) == 1) & (F.col(p) == 1)), F.count_if((F.col(y) == 0) & (F.col(p) == 1)), F.count_if((F.col(y) == 1) & (F.col(p) == 0))
    ok = F.count_if(F.col(y) == F.col(p))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.agg(
        ratio(ok, F.count(F.lit(1))).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


#: Distinct values of one range of :func:`quantile_ranges`, and ranges of a column at least and at most.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 100_000, 128, 8192


def quantile_ranges(h: DataFrame, value: str, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds ``k``: the range of ``value`` (a double) among ranges of about as many rows each, cut at approximate quantiles
    of each group of ``by``, so that what orders the values can order each range apart. Where ``ranges`` isn't given their
    number follows the rows of ``h``, which is counted; a group's cuts are one row of at most MOST_RANGES numbers."""
    n = ranges or min(max(LEAST_RANGES, h.count() // RANGE_ROWS), MOST_RANGES)
    coarse = 64
    at = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = F.percentile_approx(value, at, F.lit(10 * n)).alias("__cuts")
    per = (h.groupBy(*by).agg(cuts) if by else h.agg(cuts)).withColumn("__coarse", F.expr(f"filter(__cuts, (c, i) -> i % {coarse} = {coarse - 1})"))
    both = h.join(F.broadcast(per), by) if by else h.crossJoin(F.broadcast(per))
    # As many whole runs of cuts lie below the value as coarse cuts do; the rest is counted in the next run.
    both = both.withColumn("__full", F.size(F.filter("__coarse", lambda c: c < F.col(value))) * coarse)
    rest = F.slice("__cuts", F.col("__full") + 1, coarse)
    return both.withColumn("k", F.col("__full") + F.size(F.filter(rest, lambda c: c < F.col(value)))).drop("__cuts", "__coarse", "__full")


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve with ties halved, over counts by distinct score. Distinct scores are cut into 256 ranges at
    quantiles; each is ordered on its own and starts from the sums of the ranges before."""
    h = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))
    h = quantile_ranges(h, "s", ranges=256)
    ranges = h.groupBy("k").agg(F.sum("n").alias("n_k"))
    before = ranges.select(
        "k",
        F.coalesce(F.sum("n_k").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = h.withColumn("inside", inside).join(F.broadcast(before), "k")
    return area.agg(F.try_divide(F.sum(F.col("p") * (F.col("start") + F.col("inside") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, missing, completeness`` of each column in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns]))
    return one.select("n", rows.alias("r")).select("r.column", "r.missing", (1 - F.try_divide(F.col("r.missing"), F.col("n"))).alias("completeness"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n, share``."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("value", "n", (F.col("n") / F.col("all")).alias("share"))


def curve_steps(curve: DataFrame) -> DataFrame:
    """A curve's points with their place ``rn``, relative change ``r``, highest value so far ``top`` and ``drawdown`` from
    it. Chunks of places are worked on apart, so a curve of one point a bar is never one task."""
    placed = curve if "rn" in curve.columns else row_position(curve)
    b = placed.withColumn("__b", F.floor(F.col("rn") / CHUNK))
    before = Window.partitionBy("sym").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = b.groupBy("sym", "__b").agg(F.max("equity").alias("__t")).select("sym", "__b", F.max("__t").over(before).alias("__s"))

    def build(rows: DataFrame, over) -> DataFrame:
        # The copy of the row before a chunk is in its running maximum, where it changes nothing.
        last, inside = F.max("equity").over(over(-1, -1)), F.max("equity").over(over(Window.unboundedPreceding, 0))
        return rows.withColumns({"r": F.try_divide(F.col("equity"), last) - 1, "__v": inside})

    steps = chunk_windows(b, 1, 0, build).join(tops, ["sym", "__b"]).withColumn("top", F.greatest("__s", "__v")).drop("__b", "__s", "__v")
    return steps.withColumn("drawdown", F.try_divide(F.col("equity") - F.col("top"), F.col("top")))


def equity_metrics(curve: DataFrame, periods: int = 252, risk_free: float = 0.0) -> DataFrame:
    """Per symbol: Sharpe, Sortino, CAGR, total return and largest drawdown of ``equity`` in the order of time. The yearly
    ``risk_free`` rate is taken off the mean return; a deviation of 0 gives null."""
    c = curve_steps(curve)
    down = F.stddev_pop(F.when(F.col("r") < 0, F.col("r")))
    grown = F.try_divide(F.max_by("equity", "rn"), F.min_by("equity", "rn"))
    a = c.groupBy("sym").agg(
        (F.avg("r") - risk_free / periods).alias("m"), F.stddev_pop("r").alias("s"), down.alias("d"),
        F.count(F.lit(1)).alias("n"), grown.alias("g"), F.min("drawdown").alias("max_drawdown"),
    )
    scale = F.sqrt(F.lit(float(periods)))
    sharpe, sortino = F.try_divide(F.col("m"), F.nullif("s", F.lit(0.0))) * scale, F.try_divide(F.col("m"), F.nullif("d", F.lit(0.0))) * scale
    cagr = F.pow("g", F.lit(float(periods)) / F.col("n")) - 1
    return a.select(
        "sym", sharpe.alias("sharpe"), sortino.alias("sortino"), cagr.alias("cagr"), (F.col("g") - 1).alias("total_return"),
        "max_drawdown",
    )


def calmar() -> Column:
    """CAGR by the largest drawdown, from the columns of ``equity_metrics``; null without a drawdown."""
    return F.try_divide(F.col("cagr"), F.abs("max_drawdown"))


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    """Mean binary log loss of probabilities clipped to [eps, 1 - eps]."""
    c = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    return df.agg((-F.avg(F.when(F.col(y) == 1, F.ln(c)).otherwise(F.ln(1 - c)))).alias("log_loss"))


def weighted_class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall and F1 of each class, weighted by how often it is true, from the counts of (true, predicted)."""
    cells = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(F.inline(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("is"), F.lit(0).cast("long").alias("said"), hit.cast("long").alias("tp")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("is"), F.col("n").alias("said"), F.lit(0).cast("long").alias("tp")))))
    g = sides.groupBy("c").agg(F.sum("is").alias("is"), F.sum("said").alias("said"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    weigh = lambda e: F.try_divide(F.sum(F.col("is") * e), F.sum("is"))
    return g.agg(
        weigh(ratio(F.col("tp"), F.col("said"))).alias("precision"), weigh(ratio(F.col("tp"), F.col("is"))).alias("recall"),
        weigh(ratio(2 * F.col("tp"), F.col("said") + F.col("is"))).alias("f1"),
    )


def _histogram(df: DataFrame, current: str, columns: list[str], numeric: set[str]) -> DataFrame:
    """``column, v, c, a, b``: how often each value of each of ``columns`` (``v`` of numbers, ``c`` of others) stands in rows with
    ``current`` 0 and 1. All columns are counted in one scan, combined before the shuffle, and written once."""
    none = F.lit(None)
    each = [F.struct(F.lit(c).alias("column"), (F.col(c) if c in numeric else none).cast("double").alias("v"), (none if c in numeric else F.col(c)).cast("string").alias("c")) for c in columns]
    long = df.select(F.col(current).alias("__side"), F.inline(F.array(*each))).where("v is not null or c is not null")
    return cut(long.groupBy("column", "v", "c").agg(F.count_if(F.col("__side") == 0).alias("a"), F.count_if(F.col("__side") == 1).alias("b")))


def _ks(h: DataFrame) -> DataFrame:
    """``column, statistic, p_value`` of the Kolmogorov-Smirnov test of all columns of a histogram of numbers at once."""
    h = quantile_ranges(h.select("column", "v", "a", "b"), "v", ["column"])
    before = Window.partitionBy("column").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = h.groupBy("column", "k").agg(F.sum("a").alias("ka"), F.sum("b").alias("kb")).select(
        "column", "k", F.coalesce(F.sum("ka").over(before), F.lit(0)).alias("sa"), F.coalesce(F.sum("kb").over(before), F.lit(0)).alias("sb"),
    )
    inside = Window.partitionBy("column", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    c = h.withColumn("ca", F.sum("a").over(inside)).withColumn("cb", F.sum("b").over(inside)).join(F.broadcast(starts), ["column", "k"])
    total = h.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    d = c.join(F.broadcast(total), "column").groupBy("column").agg(
        F.max(F.abs((F.col("sa") + F.col("ca")) / F.col("na") - (F.col("sb") + F.col("cb")) / F.col("nb"))).alias("statistic"),
        F.max(F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))).alias("scale"),
    )
    lam = F.col("statistic") * F.col("scale")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda s, k: s + 2 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * lam * lam),
    )
    return d.select("column", "statistic", F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))).alias("p_value"))


def _chi2(h: DataFrame) -> DataFrame:
    """``column, statistic, dof`` of all columns of a histogram of categories at once."""
    total = h.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count(F.lit(1)).alias("k"))
    sides = [F.struct(F.col(o).cast("double").alias("o"), ((F.col("a") + F.col("b")) * F.col(n) / (F.col("na") + F.col("nb"))).alias("e")) for o, n in (("a", "na"), ("b", "nb"))]
    both = h.join(F.broadcast(total), "column").select("column", "k", F.explode(F.array(*sides)).alias("x"))
    off = F.abs(F.col("x.o") - F.col("x.e"))
    off = F.when(F.col("k") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
    return both.groupBy("column").agg(F.sum(off * off / F.col("x.e")).alias("statistic"), (F.max("k") - 1).alias("dof"))


def ks_two_sample(df: DataFrame, current: str, column: str) -> DataFrame:
    """``statistic, p_value`` of the two-sample Kolmogorov-Smirnov test between rows with ``current`` 0 and 1, over counts
    by distinct value; p by the asymptotic series. Values are cut into ranges at approximate quantiles, each ordered on
    its own from the sums before it."""
    return _ks(_histogram(df, current, [column], {column})).drop("column")


def chi2_contingency(df: DataFrame, current: str, column: str) -> DataFrame:
    """``statistic, dof`` of the 2 x k test of a category between rows with ``current`` 0 and 1; categories that one side
    lacks count 0, and a 2 x 2 table is corrected for continuity."""
    return _chi2(_histogram(df, current, [column], set())).drop("column")


def _log_density(a: Column, x: Column) -> Column:
    """ln(x^a e^-x / Gamma(a)). From a = 10 on around its peak, where ln(x / a) is taken as a whole, so that nothing large cancels."""
    stirling = lambda z: 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    z = a + 10
    shifted = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, i: s + F.ln(a + i))
    small = a * F.ln(x) - x - ((z - 0.5) * F.ln(z) - z + math.log(2 * math.pi) / 2 + stirling(z) - shifted)
    u = (x - a) / a
    large = -a * (u - F.log1p(u)) + F.ln(a / (2 * math.pi)) / 2 - stirling(a)
    return F.when(a < 10, small).otherwise(large)


def upper_gamma(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x): below x = a + 1 as 1 less the power series of the lower one,
    whose n-th term is x / (a + n) times the one before, above by Lentz's continued fraction. Both need a number of terms that
    grows with the root of a, and have it; the relative error stays under 1e-8 up to a = 500,000."""
    terms = F.lit(100) + F.ceil(12 * F.sqrt(a)).cast("int")
    steps = F.sequence(F.lit(1), terms)
    density = F.exp(_log_density(a, x))
    series = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, n: F.struct((acc["t"] * x / (a + n)).alias("t"), (acc["s"] + acc["t"] * x / (a + n)).alias("s")),
        lambda acc: acc["s"],
    )
    tiny = 1e-300
    kept = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def lentz(acc: Column, n: Column) -> Column:
        top, bottom = -n * (n - a), x + (2 * n + 1) - a
        d = 1 / kept(bottom + top * acc["d"])
        c = kept(bottom + top / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    first = 1 / kept(x + 1 - a)
    start = F.struct(F.lit(1 / tiny).alias("c"), first.alias("d"), first.alias("h"))
    fraction = F.aggregate(steps, start, lentz, lambda acc: acc["h"])
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), 1 - density / a * series)).otherwise(density * fraction)


def _p_value() -> Column:
    """Of ``statistic`` and ``dof``; without two categories 1."""
    return F.when(F.col("dof") > 0, upper_gamma(F.col("dof") / 2, F.col("statistic") / 2)).otherwise(1.0)


def chi2_test(df: DataFrame, current: str, column: str) -> DataFrame:
    """``statistic, dof, p_value`` of :func:`chi2_contingency`; without two categories the p-value is 1."""
    return chi2_contingency(df, current, column).withColumn("p_value", _p_value())


def drift_report(df: DataFrame, current: str, columns: list[str], threshold: float = 0.05) -> DataFrame:
    """``column, test, p_value, drift`` of each of ``columns`` between rows with ``current`` 0 and 1: numbers by the
    two-sample Kolmogorov-Smirnov test, others by chi-squared; drift is a p-value under the threshold (0.05 for drift of
    features, 0.1 for shifts of data). However many columns there are, the table is read once, for their histogram; a column
    without values has no row."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    h = _histogram(df, current, columns, numeric)
    parts = []
    if numeric.intersection(columns):
        parts.append(_ks(h.where("v is not null")).select("column", F.lit("ks").alias("test"), "p_value"))
    if set(columns) - numeric:
        parts.append(_chi2(h.where("c is not null")).select("column", F.lit("chi2").alias("test"), _p_value().alias("p_value")))
    return reduce(DataFrame.unionByName, parts).withColumn("drift", F.col("p_value") < threshold)


def returns_by_period(curve: DataFrame, period: str) -> DataFrame:
    """``sym, period, ret``: compounded return of each month or year between a curve's first and last, 0 where it has no
    point. The return of the first point is 0."""
    day = F.to_date(F.trunc(F.to_date("ts"), period))
    r = curve_steps(curve).select("sym", day.alias("period"), F.coalesce("r", F.lit(0.0)).alias("r"))
    g = r.groupBy("sym", "period").agg((F.product(1 + F.col("r")) - 1).alias("ret"))
    ends = g.groupBy("sym").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    slots = ends.select("sym", F.explode(F.expr(f"sequence(lo, hi, interval 1 {period})")).alias("period"))
    return slots.join(g, ["sym", "period"], "left").select("sym", "period", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def return_heatmap(curve: DataFrame) -> DataFrame:
    """Sum of relative changes by year and month, months as columns ``m1`` to ``m12``."""
    months = [F.sum(F.when(F.month("ts") == m, F.col("r"))).alias(f"m{m}") for m in range(1, 13)]
    return curve_steps(curve).groupBy("sym", F.year("ts").alias("year")).agg(*months)


def top_drawdowns(curve: DataFrame, n: int) -> DataFrame:
    """The ``n`` points of a curve with the deepest drawdown below 0; the earlier of equal ones."""
    return curve_steps(curve).where("drawdown < 0").orderBy("drawdown", "sym", "ts").limit(n).select("sym", "ts", "drawdown")
