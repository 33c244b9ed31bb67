"""Queries of model tables: orders stand for model versions, their lines for outcomes, suppliers and parts for registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import metrics
from tidemill.operators import models as mo
from tidemill.operators.cleaning import anomaly_summary, mark_anomalies
from tidemill.plans.quality import MARKS, positioned, rounded
from tidemill.plans.queries import _curve, add, table


def _predictions(s: SparkSession, d: str) -> DataFrame:
    """Each order is a prediction that one of its lines comes back; its lines tell whether one did."""
    said = table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"),
        (F.col("o_totalprice") > 150000).cast("int").alias("prediction"),
    )
    actual = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("actual"))
    return mo.prediction_outcomes(said, actual)


PREDICTED = (
    "WITH a AS (SELECT l_orderkey AS id, max((l_returnflag = 'R')::INTEGER) AS actual FROM lineitem GROUP BY 1), p AS "
    "(SELECT o_orderkey AS id, o_orderdate AS ts, (o_totalprice > 150000)::INTEGER AS prediction, actual FROM orders "
    "LEFT JOIN a ON id = o_orderkey)"
)
TRACKED = PREDICTED + ", t AS (SELECT date_trunc('{p}', ts)::TIMESTAMP AS period, count(*) AS n, avg((prediction = actual)::INTEGER) AS acc FROM p GROUP BY 1)"
add(
    "prediction_outcome_join",
    lambda s, d: _predictions(s, d).select("id", "prediction", "actual"),
    PREDICTED + " SELECT id, prediction, actual FROM p",
)
for _p in ("day", "week", "month"):
    add(
        f"accuracy_tracking_{_p}",
        lambda s, d, p=_p: rounded(mo.accuracy_tracking(_predictions(s, d), p)).withColumn("period", F.date_format("period", "yyyy-MM-dd")),
        TRACKED.format(p=_p) + " SELECT strftime(period, '%Y-%m-%d') AS period, n AS count, round(acc, 6) AS accuracy FROM t",
    )
add(
    "monitoring_alerts",
    lambda s, d: rounded(mo.monitoring_alerts(mo.accuracy_tracking(_predictions(s, d), "month"))),
    TRACKED.format(p="month") + " SELECT 'accuracy' AS kind, strftime(period, '%Y-%m-%d') AS subject, round(acc, 6) AS value FROM t WHERE acc < 0.7",
)


def _quality(s: SparkSession, d: str) -> DataFrame:
    """What the anomalies of hourly bars add up to, with the events without a value."""
    sums = anomaly_summary(mark_anomalies(positioned(s, d), spread=3.0, gap=1.5)).agg(
        F.sum("spikes").alias("spikes"), F.sum("nonpositive").alias("zero_or_negative"), F.sum("gaps").alias("gaps"),
    )
    return sums.crossJoin(F.broadcast(table(s, d, "events").agg(F.count_if(F.col("value").isNull()).alias("missing"))))


add("recommend_cleaning", lambda s, d: mo.recommend_cleaning(_quality(s, d)), f"""{MARKS}, q AS (SELECT (SELECT count(*) FILTER (value IS NULL) FROM events) AS m, sum(spike + nonpositive) AS o, sum(gap) AS g FROM m)
SELECT 'Fill or interpolate missing values.' AS step FROM q WHERE m > 0 UNION ALL SELECT 'Smooth outliers and remove zero/negative prices.' FROM q WHERE o > 0
UNION ALL SELECT 'Fill time gaps and standardize sampling.' FROM q WHERE g > 0 UNION ALL SELECT 'No major issues detected. Proceed to modeling.' FROM q WHERE m = 0 AND o = 0 AND g = 0""")
L = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
add(
    "top_features",
    lambda s, d: rounded(mo.top_features(table(s, d, "lineitem"), L, "l_extendedprice", 2)),
    "SELECT feature, round(i, 6) AS importance FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS i FROM lineitem" for c in L) + ") ORDER BY abs(i) DESC, feature LIMIT 2",
)


def _new(s: SparkSession, d: str) -> DataFrame:
    """Orders as model versions of their customer: the time of an order is its date and, in microseconds, its key."""
    o = table(s, d, "orders").withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")))
    metric = F.create_map(
        F.lit("accuracy"), F.col("o_totalprice") % 1000 / 1000, F.lit("log_loss"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") % 77 / 77),
    )
    condition = F.when(F.col("o_orderstatus") != "O", F.create_map(F.lit("market"), F.col("o_orderpriority")))
    parameters = F.struct(
        F.struct((F.col("o_orderkey") % 10).alias("depth"), (F.col("o_orderkey") % 64).alias("leaves")).alias("tree"),
        F.col("o_orderstatus").alias("kind"),
    )
    return o.select(
        F.col("o_custkey").alias("model_id"), "ts", F.col("o_orderstatus").alias("model_type"), metric.alias("metrics"),
        condition.alias("conditions"), parameters.alias("parameters"), "o_orderkey", "o_orderdate",
    )


def _versions(s: SparkSession, d: str) -> DataFrame:
    new = _new(s, d)
    return mo.add_versions(s.createDataFrame([], "model_id long, version long"), new)


def _appended(s: SparkSession, d: str) -> DataFrame:
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    old = mo.add_versions(s.createDataFrame([], "model_id long, version long"), _new(s, d).where(~late))
    return mo.add_versions(old, _new(s, d).where(late)).select("model_id", "version", "o_orderkey")


V = """WITH v AS (SELECT o_custkey AS model_id, o_orderkey, o_orderdate, o_orderkey AS k, o_orderstatus AS model_type, o_totalprice % 1000 / 1000 AS acc, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice % 77 / 77 END AS loss,
CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS cond, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders), l AS (SELECT * FROM v QUALIFY version = max(version) OVER (PARTITION BY model_id))"""
add("add_model_version", _appended, V + " SELECT model_id, version, o_orderkey FROM v WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
add(
    "model_version_latest",
    lambda s, d: mo.version_lookup(_versions(s, d)).select("model_id", "version", "o_orderkey"),
    V + " SELECT model_id, version, o_orderkey FROM l",
)
add(
    "model_version_given",
    lambda s, d: mo.version_lookup(_versions(s, d), 2).select("model_id", "version", "o_orderkey"),
    V + " SELECT model_id, version, o_orderkey FROM v WHERE version = 2",
)
BEST = " SELECT model_id, version, o_orderkey FROM v WHERE {w} ORDER BY {m}, o_orderdate, o_orderkey LIMIT 1"
add(
    "best_model",
    lambda s, d: mo.best_model(_versions(s, d), "accuracy", "F", "1996-01-01", "1999-12-31", ("market", "1-URGENT")).select("model_id", "version", "o_orderkey"),
    V + BEST.format(m="acc DESC", w="model_type = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-12-31' AND cond = '1-URGENT'"),
)
add(
    "best_model_by_loss",
    lambda s, d: mo.best_model(_versions(s, d), "log_loss").select("model_id", "version", "o_orderkey"),
    V + BEST.format(m="loss", w="loss IS NOT NULL"),
)
add(
    "compare_models",
    lambda s, d: rounded(mo.compare_models(_versions(s, d), ["accuracy", "log_loss"])),
    V + " SELECT model_id, version, round(acc, 6) AS accuracy, round(loss, 6) AS log_loss FROM l",
)
add(
    "compare_parameters",
    lambda s, d: mo.compare_parameters(_versions(s, d)),
    V + " SELECT model_id, 'tree.depth' AS parameter, (k % 10)::VARCHAR AS value FROM l UNION ALL SELECT model_id, 'tree.leaves', (k % 64)::VARCHAR FROM l UNION ALL SELECT model_id, 'kind', model_type FROM l",
)
#: Models and versions to compare; the last two don't exist.
CHOSEN = {1: None, 2: 2, 4: 1, 5: None, 7: 900, -1: None}
C = V + ", c AS (SELECT * FROM v WHERE (model_id, version) IN ((2, 2), (4, 1)) OR model_id IN (1, 5) QUALIFY version = max(version) OVER (PARTITION BY model_id))"
add(
    "compare_models_chosen",
    lambda s, d: rounded(mo.compare_models(_versions(s, d), ["accuracy", "log_loss"], CHOSEN)),
    C + " SELECT model_id, version, round(acc, 6) AS accuracy, round(loss, 6) AS log_loss FROM c",
)
add(
    "compare_parameters_chosen",
    lambda s, d: mo.compare_parameters(_versions(s, d), chosen=CHOSEN),
    C + " SELECT model_id, 'tree.depth' AS parameter, (k % 10)::VARCHAR AS value FROM c UNION ALL SELECT model_id, 'tree.leaves', (k % 64)::VARCHAR FROM c UNION ALL SELECT model_id, 'kind', model_type FROM c",
)
add(
    "perf_by_condition",
    lambda s, d: rounded(mo.performance_by_condition(_versions(s, d), "accuracy", "market")),
    V + " SELECT cond AS condition, model_type, round(avg(acc), 6) AS score FROM v WHERE cond IS NOT NULL GROUP BY 1, 2",
)
add(
    "metric_history",
    lambda s, d: rounded(mo.metric_history(_versions(s, d), "log_loss")),
    V + " SELECT model_id, version, round(loss, 6) AS value FROM v WHERE loss IS NOT NULL",
)


def _regime_events(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 4 == 0, "remove").otherwise("register")
    return table(s, d, "supplier").select(
        F.col("s_nationkey").alias("regime"), F.concat(F.lit("m"), F.col("s_suppkey") % 3).alias("model"), kind.alias("kind"),
        F.col("s_acctbal").alias("performance"), (F.col("s_suppkey") % 7 + 1).alias("trades"),
        F.col("s_suppkey").alias("event_no"),
    )


def _observed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(
        F.col("c_nationkey").alias("regime"), F.concat(F.lit("m"), F.col("c_custkey") % 4).alias("model"),
        F.col("c_acctbal").alias("performance"),
    )


REGISTRY = """WITH e AS (SELECT s_nationkey AS regime, 'm' || s_suppkey % 3 AS model, s_suppkey % 4 = 0 AS gone, s_acctbal AS performance, s_suppkey % 7 + 1 AS trades, s_suppkey FROM supplier),
g AS (SELECT regime, model, performance, trades FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY regime, model ORDER BY s_suppkey DESC) = 1) WHERE NOT gone),
o AS (SELECT c_nationkey AS regime, 'm' || c_custkey % 4 AS model, c_acctbal AS performance FROM customer)"""
add(
    "regime_model_register",
    lambda s, d: rounded(mo.regime_registry(_regime_events(s, d))),
    REGISTRY + " SELECT regime, model, round(performance, 6) AS performance, trades FROM g",
)
add(
    "regime_model_perf_update",
    lambda s, d: rounded(mo.update_performance(mo.regime_registry(_regime_events(s, d)), _observed(s, d))),
    REGISTRY + ", n AS (SELECT regime, model, sum(performance) AS sm, count(*) AS c FROM o GROUP BY 1, 2) SELECT g.regime, g.model, round(CASE WHEN c > 0 THEN (performance * trades + sm) / (trades + c) ELSE performance END, 6) AS performance, trades + coalesce(c, 0) AS trades FROM g LEFT JOIN n USING (regime, model)",
)
add(
    "regime_model_rejected",
    lambda s, d: mo.unregistered(mo.regime_registry(_regime_events(s, d)), _observed(s, d)).groupBy("regime", "model").agg(F.count(F.lit(1)).alias("n")),
    REGISTRY + " SELECT regime, model, count(*) AS n FROM o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.regime = o.regime AND g.model = o.model) GROUP BY 1, 2",
)
add(
    "best_model_for_regime",
    lambda s, d: mo.best_for_regime(mo.regime_registry(_regime_events(s, d)), table(s, d, "nation").select(F.col("n_nationkey").alias("regime"), F.col("n_name").alias("name"))),
    REGISTRY + " SELECT n_nationkey AS regime, n_name AS name, (SELECT arg_max(model, (performance, model)) FROM g WHERE g.regime = n_nationkey) AS model FROM nation",
)


def _trials(s: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("p_size") < 25, "COMPLETE").otherwise("PRUNED")
    return table(s, d, "part").select(
        F.col("p_partkey").alias("trial"), state.alias("state"), F.col("p_retailprice").alias("value"),
        F.col("p_brand").alias("parameters"),
    )


TRIALS = (
    " SELECT p_partkey AS trial, 'COMPLETE' AS state, p_retailprice AS value, p_brand AS parameters FROM part WHERE "
    "p_size < 25 ORDER BY p_retailprice {o}, p_partkey LIMIT 1"
)
add("best_trial", lambda s, d: mo.best_trial(_trials(s, d)), TRIALS.format(o="DESC"))
add("best_trial_least", lambda s, d: mo.best_trial(_trials(s, d), maximize=False), TRIALS.format(o=""))
add(
    "trial_history",
    lambda s, d: _trials(s, d).where("state = 'COMPLETE'").select("trial", "value"),
    "SELECT p_partkey AS trial, p_retailprice AS value FROM part WHERE p_size < 25",
)


def _registry_events(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "activate").otherwise("register")
    return table(s, d, "events").select(
        F.col("user_id").alias("model_id"), F.get_json_object("props", "$.k").alias("version"), kind.alias("kind"),
        F.col("event_id").alias("event_no"),
    )


EVENTS = """WITH e AS (SELECT user_id AS model_id, json_extract_string(props, '$.k') AS version, event_type IN ('click', 'view') AS act, event_id FROM events), m AS (SELECT DISTINCT model_id, version FROM e WHERE NOT act),
u AS (SELECT e.* FROM e SEMI JOIN m USING (model_id, version) WHERE act)"""
add(
    "registry_state",
    lambda s, d: mo.registry_state(_registry_events(s, d)),
    EVENTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY event_id DESC) AS k FROM u) SELECT model_id, count(*) AS versions, (SELECT version FROM r WHERE r.model_id = m.model_id AND k = 1) AS active, (SELECT version FROM r WHERE r.model_id = m.model_id AND k = 2) AS before FROM m GROUP BY model_id",
)
add(
    "registry_unknown",
    lambda s, d: mo.unknown_activations(_registry_events(s, d)).select("model_id", "version", "event_no"),
    EVENTS + " SELECT model_id, version, event_id AS event_no FROM e ANTI JOIN m USING (model_id, version) WHERE act",
)

SMALLEST = (
    "CASE WHEN max({c}) <= 127 AND min({c}) >= -128 THEN 'tinyint' WHEN max({c}) <= 32767 AND min({c}) >= -32768 THEN "
    "'smallint' WHEN max({c}) <= 2147483647 AND min({c}) >= -2147483648 THEN 'int' ELSE 'bigint' END"
)
FLOATS = "CASE WHEN bool_and(p_retailprice::FLOAT::DOUBLE = p_retailprice) THEN 'float' ELSE 'double' END"
NARROW = f"SELECT 'p_partkey' AS \"column\", 'bigint' AS before, {SMALLEST.format(c='p_partkey')} AS after FROM part UNION ALL SELECT 'p_size', 'int', {SMALLEST.format(c='p_size')} FROM part UNION ALL SELECT 'p_retailprice', 'double', {FLOATS} FROM part"
add("downcast_dtypes", lambda s, d: mo.narrow_types(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice")), NARROW)
WIDE = "CASE {c} WHEN 'tinyint' THEN 1 WHEN 'smallint' THEN 2 WHEN 'int' THEN 4 WHEN 'float' THEN 4 ELSE 8 END"
add(
    "memory_profile",
    lambda s, d: mo.memory_profile(table(s, d, "part")),
    f"WITH w AS ({NARROW}), n AS (SELECT count(*) AS n FROM part) SELECT \"column\", {WIDE.format(c='before')} * n AS bytes_before, {WIDE.format(c='after')} * n AS bytes_after FROM w, n",
)

#: Text columns of events: few kinds, times, names and values that a third lack.
TEXTS = {"kind": "event_type", "at": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "name": "'e' || event_id", "some": "CASE WHEN event_id % 3 > 0 THEN 'x' || event_id // 6 END"}


def _texts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    name = lambda c: F.concat(F.lit(c), F.col("event_id").cast("string"))
    some = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("x"), F.expr("event_id div 6").cast("string")))
    return e.select("ts", F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), name("e").alias("name"), some.alias("some"))


_text_sql = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (v IS NULL) AS nulls, count(try_cast(v AS TIMESTAMP)) AS parsed, count(DISTINCT v) + max((v IS NULL)::INTEGER) AS d FROM (SELECT {e} AS v FROM events)" for c, e in TEXTS.items())
add(
    "narrow_strings",
    lambda s, d: mo.narrow_strings(_texts(s, d), list(TEXTS)).drop("distinct"),
    f"SELECT \"column\", rows, nulls, parsed, CASE WHEN d / rows < 0.5 THEN 'category' WHEN parsed > 0 THEN 'timestamp' ELSE 'string' END AS kind FROM ({_text_sql})",
)


def _strategies(s: SparkSession, d: str) -> DataFrame:
    """A curve for each order priority, a strategy each."""
    o = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("sym"), F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("equity"))
    m = metrics.equity_metrics(o)
    return m.select(F.col("sym").alias("strategy"), "cagr", "max_drawdown", metrics.calmar().alias("calmar"))


BY = (
    "WITH c AS (SELECT {k} AS strategy, o_orderdate AS ts, sum(o_totalprice) AS equity FROM orders GROUP BY ALL), r AS "
    "(SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY ts) AS top FROM c), m AS (SELECT strategy, "
    "pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / count(*)) - 1 AS g, min((equity - top) / top) AS dd FROM r "
    "GROUP BY 1)"
)
add(
    "compare_strategies",
    lambda s, d: rounded(_strategies(s, d)),
    BY.format(k="o_orderpriority") + " SELECT strategy, round(g, 6) AS cagr, round(dd, 6) AS max_drawdown, round(g / nullif(abs(dd), 0), 6) AS calmar FROM m",
)
add(
    "perf_calmar",
    lambda s, d: rounded(metrics.equity_metrics(_curve(s, d)).select("sym", metrics.calmar().alias("calmar"))),
    BY.format(k="'all'") + " SELECT strategy AS sym, round(g / nullif(abs(dd), 0), 6) AS calmar FROM m",
)
