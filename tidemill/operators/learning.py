"""Targets, splits, folds, scaling, selection and ensembles for models of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.core import chunk_windows, grouped_quantiles


def forward_max_target(df: DataFrame, window: int, threshold: float, out: str = "target", tail: str = "zero") -> DataFrame:
    """1 where the highest close of this row and the ``window - 1`` after it is ``threshold`` or more above this close, 0
    elsewhere. A symbol's last ``window`` rows, whose future isn't known in full, have 0 (``tail`` "zero") or null ("null")."""
    if tail not in ("zero", "null"):
        raise ValueError("tail is zero or null")

    def build(b: DataFrame, over) -> DataFrame:
        ahead, whole = over(0, window - 1), F.count(F.lit(1)).over(over(0, window)) == window + 1
        hit = whole & (F.count("close").over(ahead) == window) & (F.max("close").over(ahead) - F.col("close") >= threshold)
        target = F.when(hit, 1).otherwise(0)
        return b.withColumn(out, F.when(whole, target) if tail == "null" else target)

    return chunk_windows(df, 0, window, build)


def make_sequences(df: DataFrame, columns: list[str], steps: int, target: str, offset: int = 0) -> DataFrame:
    """``sym, ts, sequence, label``: each full run of ``steps`` rows of ``columns`` and the target ``offset`` rows after its last."""

    def build(b: DataFrame, over) -> DataFrame:
        return b.withColumn("sequence", F.collect_list(F.array(*columns)).over(over(1 - steps, 0))).withColumn(
            "label", F.max(target).over(over(offset, offset)),
        )

    return chunk_windows(df, steps - 1, offset, build).where((F.size("sequence") == steps) & F.col("label").isNotNull()).select(
        "sym", "ts", "sequence", "label",
    )


def _with_count(df: DataFrame) -> DataFrame:
    return df.join(df.groupBy("sym").agg(F.count(F.lit(1)).alias("n")), "sym")


def split_time(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Adds ``part``: train, val or test by position, cut at the whole part of the count times the share."""
    if not (0 < train < 1 and 0 < val < 1 and train + val < 1):
        raise ValueError("shares must be between 0 and 1, and so must their sum")
    part = F.when(F.col("rn") < F.floor(F.col("n") * F.lit(train)), "train").when(F.col("rn") < F.floor(F.col("n") * F.lit(train + val)), "val").otherwise("test")
    return _with_count(df).withColumn("part", part).drop("n")


def split_holdout(df: DataFrame, test: float = 0.2, val: float = 0.2) -> DataFrame:
    """Adds ``part``: the last ceil(n * test) rows are test, the last ceil(m * val) of the m before them val."""
    held = _with_count(df).withColumn("m", F.col("n") - F.ceil(F.col("n") * F.lit(test)))
    part = F.when(F.col("rn") >= F.col("m"), "test").when(F.col("rn") >= F.col("m") - F.ceil(F.col("m") * F.lit(val)), "val").otherwise("train")
    return held.withColumn("part", part).drop("n", "m")


def _folds(counted: DataFrame, test_start: Column, train_start: Column, test: Column) -> DataFrame:
    """Folds from an array of the starts of their test ranges; ends are exclusive."""
    f = counted.select("sym", "n", F.posexplode(test_start).alias("fold", "a")).withColumn("t", test)
    f = f.select(
        "sym", "fold", train_start.alias("train_start"), F.col("a").alias("train_end"), F.col("a").alias("test_start"),
        (F.col("a") + F.col("t")).alias("test_end"), "n",
    )
    return f.where("test_end <= n").drop("n")


def _steps(first: Column, last: Column, step: int) -> Column:
    return F.when(last >= first, F.sequence(first, last, F.lit(step).cast("long")))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def cv_timeseries_split(counted: DataFrame, splits: int, step: int, test: int | None = None, max_train: int | None = None) -> DataFrame:
    """Folds of each ``sym, n``: the k-th trains up to test + k * step (on ``max_train`` rows at most) and tests on what
    follows; test is n // (splits + 1) unless given. Folds past the end fall away."""
    size = _long(test) if test else F.floor(F.col("n") / (splits + 1))
    start = F.greatest(F.lit(0), F.col("a") - max_train).cast("long") if max_train else _long(0)
    return _folds(counted, F.transform(F.sequence(_long(0), _long(splits - 1)), lambda k: size + k * step), start, size)


def cv_rolling_window(counted: DataFrame, window: int, step: int, test: int) -> DataFrame:
    """Folds that train on ``window`` rows and slide by ``step``."""
    return _folds(counted, _steps(_long(window), F.col("n") - test, step), F.col("a") - window, _long(test))


def cv_expanding_window(counted: DataFrame, initial: int, step: int, test: int) -> DataFrame:
    """Folds that train on all rows before their test range."""
    return _folds(counted, _steps(_long(initial), F.col("n") - test, step), _long(0), _long(test))


def cv_expanding_share(counted: DataFrame, folds: int) -> DataFrame:
    """A fixed number of folds over the whole series: each ``sym, n`` is cut into ``folds + 1`` parts as equal as can be,
    and fold k trains on the parts before part k + 1 and tests on it. Empty ranges fall away."""
    cut = lambda k: F.floor(F.col("n") * k / (folds + 1)).cast("long")
    f = counted.select("sym", "n", F.posexplode(F.sequence(_long(1), _long(folds))).alias("fold", "k"))
    f = f.select(
        "sym", "fold", _long(0).alias("train_start"), cut(F.col("k")).alias("train_end"), cut(F.col("k")).alias("test_start"),
        cut(F.col("k") + 1).alias("test_end"),
    )
    return f.where("train_end > 0 and test_end > test_start")


def param_grid_cross(folds: DataFrame, grid: DataFrame) -> DataFrame:
    """Every set of parameters (a row of ``grid``, which is a parameter and broadcast) with every fold."""
    return folds.crossJoin(F.broadcast(grid))


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row with every fold whose train or test range holds it, and ``role``. Folds are spread over the blocks of
    256 positions they touch, so that the join is one on equal keys."""
    block = lambda c: F.floor(F.col(c) / 256)
    spread = folds.withColumn("__k", F.explode(F.sequence(block("train_start"), F.floor((F.col("test_end") - 1) / 256))))
    found = df.withColumn("__k", block("rn")).join(spread, ["sym", "__k"]).where((F.col("rn") >= F.col("train_start")) & (F.col("rn") < F.col("test_end")))
    return found.withColumn("role", F.when(F.col("rn") < F.col("train_end"), "train").otherwise("test")).drop("__k")


def scale_statistics(train: DataFrame, columns: list[str], kind: str) -> list[tuple[float, float]]:
    """Centre and spread of each column, nulls as 0 and a spread of 0 as 1. Kinds: standard (mean and population
    deviation), minmax, and robust (median and the range between the quartiles). One row of figures."""
    zero = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    if kind == "robust":
        rows = grouped_quantiles(zero, [], columns, [0.25, 0.5, 0.75]).collect()  # three rows a column
        at = {(r.column, r.share): r.value for r in rows}
        found = [(at.get((c, 0.5)), at.get((c, 0.75), 0.0) - at.get((c, 0.25), 0.0)) for c in columns]
    else:
        pairs = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c))}[kind]
        row = zero.agg(*[f(c).alias(f"{i}{k}") for k, c in enumerate(columns) for i, f in enumerate(pairs)]).first()
        found = [(row[f"0{k}"], row[f"1{k}"]) for k in range(len(columns))]
    return [(centre or 0.0, spread or 1.0) for centre, spread in found]


def scale(df: DataFrame, columns: list[str], kind: str, train: Column) -> DataFrame:
    """``columns`` scaled with :func:`scale_statistics` of the ``train`` rows; nulls count as 0."""
    found = zip(columns, scale_statistics(df.where(train), columns, kind), strict=True)
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - centre) / spread for c, (centre, spread) in found})


def variance_select(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    """``column, variance`` of columns whose population variance, nulls as 0, is above the threshold."""
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.var_pop(F.coalesce(F.col(c), F.lit(0.0))).alias("variance")).alias(c) for c in columns])
    return one.select(F.inline(F.array(*columns))).where(F.col("variance") > threshold)


def correlation_select(df: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    """``column`` of those not correlated beyond the threshold with an earlier one, over rows that have both."""
    both = lambda a, b: F.abs(F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))))
    worst = [F.struct(F.lit(c).alias("column"), F.greatest(F.lit(0.0), F.lit(0.0), *[both(e, c) for e in columns[:k]]).alias("r")).alias(c) for k, c in enumerate(columns)]
    return df.agg(*worst).select(F.inline(F.array(*columns))).where(F.col("r") <= threshold).select("column")


def threshold_sweep(df: DataFrame, prob: str, thresholds: list[float]) -> DataFrame:
    """``threshold, score``: the mean probability of rows above each threshold in one pass, -inf where there is none."""
    means = [F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.avg(F.when(F.col(prob) > t, F.col(prob))), F.lit(float("-inf"))).alias("score")) for t in thresholds]
    return df.agg(F.array(*means).alias("a")).select(F.inline("a"))


def stability(scores: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation, extremes and coefficient of variation of fold scores."""
    mean, std = F.avg(column), F.stddev_pop(column)
    return scores.agg(
        mean.alias("mean_score"), std.alias("std_score"), F.min(column).alias("min_score"), F.max(column).alias("max_score"),
        F.try_divide(std, mean).alias("cv_score"),
    )


def ensemble_simple(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the predictions that there are, and 1 / their number as confidence."""
    return preds.groupBy(*keys).agg(F.avg("prob").alias("prob"), F.try_divide(F.lit(1.0), F.count("prob")).alias("confidence"))


def ensemble_weighted(preds: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Mean weighted by performance (null as 0), plain where the weights add up to 0; the largest share is the confidence."""
    some = preds.where("prob is not null").withColumn("__w", F.coalesce(weight, F.lit(0.0)))
    total = F.sum("__w")
    a = some.groupBy(*keys).agg(
        F.when(total == 0, F.avg("prob")).otherwise(F.try_divide(F.sum(F.col("prob") * F.col("__w")), total)).alias("prob"),
        F.when(total == 0, 1.0 / F.count(F.lit(1))).otherwise(F.try_divide(F.max("__w"), total)).alias("confidence"),
    )
    return a


def ensemble_vote(preds: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """The most frequent vote, the smallest of equally frequent ones, and its share."""
    counts = preds.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy(*keys).agg(F.max(F.struct("c", (-F.col(vote)).alias("v"))).alias("t"), F.sum("c").alias("all"))
    return top.select(*keys, (-F.col("t.v")).alias("vote"), (F.col("t.c") / F.col("all")).alias("confidence"))


def signal_multi_timeframe(df: DataFrame, threshold: float = 0.55, frames: tuple[str, ...] = ("4h", "1h")) -> DataFrame:
    """Adds ``signal``: Flat below the threshold or where a value is missing; Long if close is above the mean and RSI
    over 50 in every time frame (columns ``<frame>_ema_20``, ``<frame>_rsi_14``), Short if both are below, else Flat."""
    need = [f"{f}_{c}" for f in frames for c in ("ema_20", "rsi_14")]
    if set(need) - set(df.columns):
        return df.withColumn("signal", F.lit("Flat"))
    all_of = lambda side: reduce(lambda a, b: a & b, [side(F.col("close"), F.col(f"{f}_ema_20")) & side(F.col(f"{f}_rsi_14"), F.lit(50.0)) for f in frames])
    sure = F.col("prob") >= threshold
    return df.withColumn(
        "signal",
        F.when(sure & all_of(lambda a, b: a > b), "Long").when(sure & all_of(lambda a, b: a < b), "Short").otherwise("Flat"),
    )


def ab_assign(df: DataFrame, key: str, ratio: float, salt: str) -> DataFrame:
    """Adds ``version``: A for the share ``ratio`` of keys, by a hash, so that a key keeps its version."""
    part = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    return df.withColumn("version", F.when(part < ratio, "A").otherwise("B"))
