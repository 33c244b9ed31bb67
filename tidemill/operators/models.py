"""Tables of models: monitored predictions, versions, registries, regimes and trials. All are plain joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.core import cut, row_position

#: Metrics of which less is better. A name that holds one of them counts, so ``val_loss`` does too.
LESS_IS_BETTER = ("loss", "error", "mse", "rmse", "mae")
#: Numeric types from narrow to wide, their bytes and the largest whole number each holds.
INTEGERS = [("tinyint", 1, 2**7 - 1), ("smallint", 2, 2**15 - 1), ("int", 4, 2**31 - 1), ("bigint", 8, 2**63 - 1)]
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def prediction_outcomes(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions (``id, ts, prediction``) with the ``actual`` of their ``id``, null where none has come."""
    return predictions.join(outcomes.select("id", "actual"), "id", "left")


def accuracy_tracking(matched: DataFrame, period: str = "day") -> DataFrame:
    """``period, count, accuracy``: all predictions of each period, and the share of right ones among those with an outcome."""
    right = (F.col("prediction") == F.col("actual")).cast("double")
    return matched.groupBy(F.date_trunc(period, "ts").alias("period")).agg(F.count(F.lit(1)).alias("count"), F.avg(right).alias("accuracy"))


def monitoring_alerts(tracked: DataFrame, drift: DataFrame | None = None, least: float = 0.7, level: float = 0.05) -> DataFrame:
    """``kind, subject, value``: periods whose accuracy is under ``least``, and columns (``column, p_value``) that drift."""
    low = tracked.where(F.col("accuracy") < least).select(
        F.lit("accuracy").alias("kind"), F.date_format("period", "yyyy-MM-dd").alias("subject"), F.col("accuracy").alias("value"),
    )
    if drift is None:
        return low
    return low.unionByName(drift.where(F.col("p_value") < level).select(F.lit("drift").alias("kind"), F.col("column").alias("subject"), F.col("p_value").alias("value")))


def recommend_cleaning(report: DataFrame) -> DataFrame:
    """``step``: advice from one row of ``missing, spikes, zero_or_negative, gaps`` counts."""
    # The wording of the advice.
    advice = [
        (F.col("missing") > 0, "Fill or interpolate missing values."),
        ((F.col("spikes") > 0) | (F.col("zero_or_negative") > 0), "Smooth outliers and remove zero/negative prices."),
        (F.col("gaps") > 0, "Fill time gaps and standardize sampling."),
    ]
    steps = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in advice]))
    none = F.array(F.lit("No major issues detected. Proceed to modeling."))
    return report.select(F.explode(F.when(F.size(steps) > 0, steps).otherwise(none)).alias("step"))


def top_features(df: DataFrame, features: list[str], target: str, n: int) -> DataFrame:
    """The ``n`` features with the largest absolute correlation with ``target``, found in one pass."""
    one = df.agg(*[F.corr(c, target).alias(c) for c in features])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in features])))
    return long.orderBy(F.abs("importance").desc_nulls_last(), "feature").limit(n)


def add_versions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows (``model_id, ts``, unique within a model) with the next ``version`` numbers of their model, from 1."""
    last = existing.groupBy("model_id").agg(F.max("version").alias("__last"))
    numbered = row_position(new.withColumnRenamed("model_id", "sym")).withColumnRenamed("sym", "model_id")
    return numbered.join(last, "model_id", "left").withColumn("version", F.coalesce("__last", F.lit(0)) + F.col("rn") + 1).drop("__last", "rn")


def version_lookup(versions: DataFrame, version: int | None = None) -> DataFrame:
    """One row a model: its latest version, or the given one where it exists."""
    if version is not None:
        return versions.where(F.col("version") == version)
    return versions.groupBy("model_id").agg(F.max_by(F.struct(*versions.columns), "version").alias("__v")).select("__v.*")


def chosen_versions(versions: DataFrame, chosen: dict | None = None) -> DataFrame:
    """One row for each model of ``chosen`` (id and version, or None for the latest) that exists; without it the latest version of
    every model. The choice is a parameter and goes to every task."""
    if chosen is None:
        return version_lookup(versions)
    kinds = {c: versions.schema[c].dataType.simpleString() for c in ("model_id", "version")}
    wanted = versions.sparkSession.createDataFrame(list(chosen.items()), f"model_id {kinds['model_id']}, __wanted {kinds['version']}")
    rows = versions.join(F.broadcast(wanted), "model_id").where("__wanted is null or __wanted = version").drop("__wanted")
    return version_lookup(rows.select(*versions.columns))


def less_is_better(metric: str) -> bool:
    return any(part in metric.lower() for part in LESS_IS_BETTER)


def best_model(versions: DataFrame, metric: str, model_type: str | None = None, since: str | None = None, until: str | None = None, condition: tuple[str, str] | None = None) -> DataFrame:
    """The version with the best ``metrics[metric]`` (the smallest for losses and errors), the earliest of equal ones.
    ``condition`` is a key and a value of ``conditions``; versions that have no conditions pass."""
    rows = versions.withColumn("__m", F.col("metrics")[metric]).where("__m is not null")
    if model_type is not None:
        rows = rows.where(F.col("model_type") == model_type)
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    if condition is not None:
        rows = rows.where(F.col("conditions").isNull() | (F.col("conditions")[condition[0]] == condition[1]))
    good = F.col("__m") if less_is_better(metric) else -F.col("__m")
    best = rows.agg(F.min_by(F.struct(*versions.columns), F.struct(good, "ts", "model_id", "version")).alias("__v"))
    return best.where("__v is not null").select("__v.*")


def compare_models(versions: DataFrame, metrics: list[str], chosen: dict | None = None) -> DataFrame:
    """``model_id, version`` and the ``metrics`` of :func:`chosen_versions`, null where absent."""
    return chosen_versions(versions, chosen).select("model_id", "version", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics])


def _leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    return [leaf for f in schema for leaf in (_leaves(f.dataType, f"{prefix}{f.name}.") if isinstance(f.dataType, T.StructType) else [prefix + f.name])]


def compare_parameters(versions: DataFrame, column: str = "parameters", chosen: dict | None = None) -> DataFrame:
    """``model_id, parameter, value``: the nested ``column`` of :func:`chosen_versions`, by dotted names."""
    names = _leaves(versions.schema[column].dataType)
    pairs = F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(f"{column}.{n}").cast("string").alias("value")) for n in names])
    return chosen_versions(versions, chosen).select("model_id", F.inline(pairs))


def performance_by_condition(versions: DataFrame, metric: str, condition: str) -> DataFrame:
    """``condition, model_type, score``: the mean metric of the versions that name the condition."""
    rows = versions.where(F.map_contains_key("conditions", condition)).select(
        F.col("conditions")[condition].alias("condition"), "model_type", F.col("metrics")[metric].alias("m"),
    )
    return rows.where("m is not null").groupBy("condition", "model_type").agg(F.avg("m").alias("score"))


def metric_history(versions: DataFrame, metric: str) -> DataFrame:
    """``model_id, version, value`` of the versions that have the metric."""
    return versions.select("model_id", "version", F.col("metrics")[metric].alias("value")).where("value is not null")


def regime_registry(events: DataFrame) -> DataFrame:
    """``regime, model, performance, trades`` after all events (``event_no`` in order; ``kind`` register or remove): the last one of a pair counts."""
    last = events.groupBy("regime", "model").agg(F.max_by(F.struct("kind", "performance", "trades"), "event_no").alias("e"))
    return last.where("e.kind = 'register'").select("regime", "model", "e.performance", "e.trades")


def update_performance(registry: DataFrame, observed: DataFrame) -> DataFrame:
    """The registry after ``observed`` (``regime, model, performance``) has gone into its running means. Pairs that aren't registered change nothing."""
    new = observed.groupBy("regime", "model").agg(F.sum("performance").alias("__s"), F.count("performance").alias("__n"))
    n = F.coalesce("__n", F.lit(0))
    mean = F.when(n > 0, (F.col("performance") * F.col("trades") + F.col("__s")) / (F.col("trades") + n)).otherwise(F.col("performance"))
    return registry.join(new, ["regime", "model"], "left").select("regime", "model", mean.alias("performance"), (F.col("trades") + n).alias("trades"))


def unregistered(registry: DataFrame, observed: DataFrame) -> DataFrame:
    """Observations of pairs that the registry lacks."""
    return observed.join(registry, ["regime", "model"], "left_anti")


def best_for_regime(registry: DataFrame, current: DataFrame) -> DataFrame:
    """``current`` (with ``regime``) with the model that performs best in it, the first by name of equal ones; null if none is known."""
    best = registry.groupBy("regime").agg(F.min_by("model", F.struct(-F.col("performance"), "model")).alias("model"))
    return current.join(best, "regime", "left")


def best_trial(trials: DataFrame, maximize: bool = True) -> DataFrame:
    """The finished trial with the best ``value``, the lowest ``trial`` of equal ones."""
    done = trials.where("state = 'COMPLETE' and value is not null")
    good = -F.col("value") if maximize else F.col("value")
    return done.agg(F.min_by(F.struct(*trials.columns), F.struct(good, "trial")).alias("__t")).where("__t is not null").select("__t.*")


def registry_state(events: DataFrame) -> DataFrame:
    """``model_id, versions, active, before``: how many versions are registered, the one activated last, and the one that a
    rollback returns to. Activations of versions that were never registered don't count (``unknown_activations``)."""
    made = events.where("kind = 'register'").select("model_id", "version").distinct()
    used = events.where("kind = 'activate'").join(made, ["model_id", "version"], "left_semi")
    last = used.groupBy("model_id", "version").agg(F.max("event_no").alias("at")).groupBy("model_id")
    active = last.agg(F.max_by("version", "at").alias("active"), F.max("at").alias("at"))
    earlier = used.join(active, "model_id").where(F.col("event_no") < F.col("at")).groupBy("model_id").agg(F.max_by("version", "event_no").alias("before"))
    return made.groupBy("model_id").agg(F.count(F.lit(1)).alias("versions")).join(active.drop("at"), "model_id", "left").join(
        earlier, "model_id", "left",
    )


def unknown_activations(events: DataFrame) -> DataFrame:
    made = events.where("kind = 'register'").select("model_id", "version")
    return events.where("kind = 'activate'").join(made, ["model_id", "version"], "left_anti")


def narrow_types(df: DataFrame) -> DataFrame:
    """``column, before, after``: for each numeric column the narrowest type that holds every value (a double becomes a
    float only where each value survives the cast). One pass and one row; a column without values keeps its type."""
    parts, kinds = [], dict(df.dtypes)
    for c, kind in kinds.items():
        after: Column = F.lit(kind)
        if kind in [k for k, _, _ in INTEGERS]:
            most = F.max(F.greatest(F.col(c), -1 - F.col(c)))
            wide = [(k, top) for k, width, top in INTEGERS if width <= WIDTHS[kind]]
            after = reduce(lambda rest, kt: F.when(most <= F.lit(kt[1]), F.lit(kt[0])).otherwise(rest), reversed(wide), F.lit(kind))
        elif kind == "double":
            same = F.col(c).cast("float").cast("double").eqNullSafe(F.col(c))
            after = F.when(F.bool_and(same) & (F.count(c) > 0), F.lit("float")).otherwise(F.lit(kind))
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("before"), after.alias("after")))
    return df.agg(F.array(*parts).alias("__p")).select(F.inline("__p"))


#: Bits of a distinct-count sketch's buckets, the relative standard error that follows from them, and the share of distinct
#: values under which text is a category.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / (1 << SKETCH_BITS) ** 0.5
CATEGORY_SHARE = 0.5


def string_summaries(df: DataFrame, columns: list[str], time: str = "ts", period: str = "day") -> DataFrame:
    """``column, period, rows, nulls, parsed, sketch`` of text columns by period of time: how many values are missing and how many are
    times, and a sketch of the distinct ones. Summaries of new periods are added to those stored; none is made again."""
    each = [F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns]
    long = df.select(F.date_trunc(period, time).alias("period"), F.inline(F.array(*each)))
    return long.groupBy("column", "period").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count(F.col("v").try_cast("timestamp")).alias("parsed"),
        F.hll_sketch_agg("v", SKETCH_BITS).alias("sketch"),
    )


def string_kinds(summaries: DataFrame, share: float = CATEGORY_SHARE) -> DataFrame:
    """``column, rows, nulls, parsed, distinct, kind`` from summaries of all periods: ``category`` where fewer than ``share`` of the rows are
    distinct values (null is one), else ``timestamp`` where a value is a time, else ``string``; ``unsure`` where the sketch's error, three
    times its standard, leaves the share open."""
    merged = summaries.groupBy("column").agg(*[F.sum(c).alias(c) for c in ("rows", "nulls", "parsed")], F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    distinct = F.col("distinct") + F.when(F.col("nulls") > 0, 1).otherwise(0)
    ratio = distinct / F.col("rows")
    open_ = F.abs(ratio - share) <= 3 * SKETCH_ERROR * ratio
    kind = F.when(open_, "unsure").when(ratio < share, "category").when(F.col("parsed") > 0, "timestamp").otherwise("string")
    return merged.select("column", "rows", "nulls", "parsed", distinct.alias("distinct"), kind.alias("kind"))


def narrow_strings(df: DataFrame, columns: list[str], time: str = "ts", share: float = CATEGORY_SHARE) -> DataFrame:
    """:func:`string_kinds` of a table. Only columns whose share the sketch leaves open are counted exactly, in one more scan."""
    found = cut(string_kinds(string_summaries(df, columns, time), share))
    unsure = [r["column"] for r in found.where("kind = 'unsure'").collect()]  # a row a column at most
    if not unsure:
        return found
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in unsure]))).distinct()
    exact = values.groupBy("column").agg(F.count(F.lit(1)).alias("exact"))
    kind = F.when(F.col("exact") / F.col("rows") < share, "category").when(F.col("parsed") > 0, "timestamp").otherwise("string")
    both = found.join(F.broadcast(exact), "column", "left")
    return both.select("column", "rows", "nulls", "parsed", F.coalesce("exact", "distinct").alias("distinct"), F.when(F.col("exact").isNull(), F.col("kind")).otherwise(kind).alias("kind"))


def parse_times(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """``df`` with its columns of kind ``timestamp`` as timestamps, null where a value is none. Categories stay text: files encode
    them by dictionaries as they are."""
    times = {r["column"] for r in kinds.where("kind = 'timestamp'").collect()}
    return df.withColumns({c: F.col(c).try_cast("timestamp") for c in df.columns if c in times})


def downcast(df: DataFrame) -> DataFrame:
    """``df`` in the types of ``narrow_types`` (one row a column comes to the driver)."""
    plan = {r["column"]: r["after"] for r in narrow_types(df).collect()}
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if plan[c] != k else F.col(c) for c, k in df.dtypes])


def memory_profile(df: DataFrame) -> DataFrame:
    """``column, bytes_before, bytes_after`` of the fixed-width columns under ``narrow_types``."""
    width = F.create_map(*[F.lit(x) for kv in WIDTHS.items() for x in kv])
    sized = narrow_types(df).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n"))))
    return sized.select("column", (width[F.col("before")] * F.col("n")).alias("bytes_before"), (width[F.col("after")] * F.col("n")).alias("bytes_after")).where("bytes_before is not null")
