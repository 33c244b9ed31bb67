"""Searches over seeded random spaces of parameters, by successive halving."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators.core import cut
from tidemill.operators.training import quality, score_batch, train_gbt, train_random_forest

#: A parameter is drawn from a list of values, from (low, high) whole numbers with both ends, from (low, high) numbers, or from
#: ("log", low, high) by equal shares of the logarithm.
Space = dict[str, list | tuple]


def uniform(*parts: Column | str) -> Column:
    """A number from 0 to under 1 by a hash of the parts as text."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def draw_trials(spark: SparkSession, space: Space, n: int, seed: int | str = 42) -> DataFrame:
    """``trial`` from 0 and a column for each parameter: ``n`` draws by a hash of seed, name and trial, so that a trial is the same
    in every run, whatever ``n`` and the other parameters are."""
    columns = []
    for name, domain in space.items():
        u = uniform(str(seed), name, F.col("trial"))
        if isinstance(domain, list):
            value = F.get(F.array(*[F.lit(v) for v in domain]), F.floor(u * len(domain)).cast("int"))
        elif domain[0] == "log":
            value = F.lit(float(domain[1])) * F.pow(F.lit(domain[2] / domain[1]), u)
        elif all(isinstance(v, int) for v in domain):
            value = (F.lit(domain[0]) + F.floor(u * (domain[1] - domain[0] + 1))).cast("int")
        else:
            value = F.lit(float(domain[0])) + u * (domain[1] - domain[0])
        columns.append(value.alias(name))
    return spark.range(n).select(F.col("id").alias("trial"), *columns)


def successive_halving(trials: DataFrame, evaluate: Callable[[DataFrame, float], DataFrame], rungs: int = 3, eta: int = 3, maximize: bool = True) -> DataFrame:
    """``rung, trial, share, value, promoted``: all trials on a small share of the rows, of which the best ``1 / eta`` (at least one) go
    on to ``eta`` times the share, until the last rung has all rows. Of equal values the lower trial is better; trials without a value
    come last. ``evaluate(trials, share)`` gives ``trial, value``. Each rung is written before the next begins."""
    table: list[DataFrame] = []
    left = trials
    for rung in range(rungs):
        share = float(eta) ** (rung + 1 - rungs)
        found = left.select("trial").join(evaluate(left, share), "trial", "left")
        good = F.desc_nulls_last("value") if maximize else F.asc_nulls_last("value")
        place = F.row_number().over(Window.orderBy(good, "trial"))  # one row a trial
        ranked = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).withColumn("place", place)
        promoted = (F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / eta))) & F.lit(rung + 1 < rungs)
        done = cut(ranked.select(F.lit(rung).alias("rung"), "trial", F.lit(share).alias("share"), F.col("value").cast("double").alias("value"), promoted.alias("promoted")))
        table.append(done)
        left = trials.join(F.broadcast(done.where("promoted").select("trial")), "trial", "left_semi")
    return reduce(DataFrame.unionByName, table)


def halving_winner(rungs: DataFrame, trials: DataFrame, maximize: bool = True) -> DataFrame:
    """The best trial of the last rung with its ``value`` and its parameters."""
    last = rungs.where(F.col("rung") == rungs.agg(F.max("rung")).first()[0]).where("value is not null")
    good = F.desc("value") if maximize else F.asc("value")
    return last.orderBy(good, "trial").limit(1).select("trial", "value").join(trials, "trial")


def in_share(share: float, *keys: str) -> Column:
    """Whether a row is in a share of the rows: those of a smaller share are in every larger one."""
    return uniform("rows", *[F.col(k) for k in keys]) < share


def fitted_trials(labelled: DataFrame, columns: list[str], metric: str = "auc", parallel: int = 4) -> Callable[[DataFrame, float], DataFrame]:
    """An ``evaluate`` for :func:`successive_halving` that fits each trial (``model``: forest or boosted, ``trees``, ``depth``) on the share
    of the rows of part train, with as large a share of its trees, and measures it on part val. The trials, a bounded table, come to
    the driver, which has ``parallel`` fits run side by side."""
    rows = cut(labelled)

    def evaluate(trials: DataFrame, share: float) -> DataFrame:
        own = rows.where(F.col("part") != "train").unionByName(rows.where(F.col("part") == "train").where(in_share(share, "sym", "rn")))
        held = rows.where(F.col("part") == "val")

        def measured(trial) -> tuple[int, float | None]:
            trees = max(1, round(trial.trees * share))
            if trial.model == "boosted":
                model = train_gbt(own, columns, rounds=trees, depth=trial.depth)
            else:
                model = train_random_forest(own.where("part = 'train'"), columns, trees=trees, depth=trial.depth)
            return trial.trial, quality(score_batch(model, held), metric == "auc").select(metric).first()[0]

        with ThreadPoolExecutor(parallel) as pool:
            found = list(pool.map(inheritable_thread_target(rows.sparkSession)(measured), sorted(trials.collect())))
        return rows.sparkSession.createDataFrame(found, "trial long, value double")

    return evaluate
