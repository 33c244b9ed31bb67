"""Queries of training sets, models and searches over bars of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import learning as le
from tidemill.operators import models as mo
from tidemill.operators import search as se
from tidemill.operators import training as tr
from tidemill.operators import trees as tt
from tidemill.operators.core import cut, row_position
from tidemill.operators.indicators import finite_indicators
from tidemill.plans.quality import positioned, rounded
from tidemill.plans.queries import BARS, ORACLE_SQL, SCORED, _scored, _sma, add, shown

#: Folds of a walk over the whole series; the driver starts one fit for each and set of parameters.
FOLDS = 4
X = ["sma_10", "sma_20", "volume_osc", "roc_5"]


def _rows(s: SparkSession, d: str) -> DataFrame:
    return tr.training_set(finite_indicators(positioned(s, d)), X, 10, 60.0)


def _part(s: SparkSession, d: str, *parts: str) -> DataFrame:
    return _rows(s, d).where(F.col("part").isin(*parts))


def _forest(s: SparkSession, d: str):
    return tr.train_random_forest(_part(s, d, "train"), X)


def _folds(s: SparkSession, d: str) -> DataFrame:
    n = _rows(s, d).groupBy("sym").agg(F.count(F.lit(1)).alias("n"))
    return le.cv_expanding_share(n, FOLDS)


def _gbt(s: SparkSession, d: str) -> DataFrame:
    rows = cut(_rows(s, d))
    return tr.score_batch(tr.train_gbt(rows, X), rows.where("part = 'test'"))


GRID = [{"trees": 10, "depth": 2}, {"trees": 20, "depth": 4}]
add("training_set", lambda s, d: _rows(s, d).groupBy("sym", "part", "target").agg(F.count(F.lit(1)).alias("n")), f"""{BARS}, y AS (SELECT *, CASE WHEN lead(rn, 10) OVER (PARTITION BY sym ORDER BY rn) IS NOT NULL AND max(close) OVER (PARTITION BY sym ORDER BY rn ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) - close >= 60 THEN 1 ELSE 0 END AS target,
lag(close, 5) OVER (PARTITION BY sym ORDER BY rn) AS c5 FROM bars), z AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY rn) - 1 AS k, count(*) OVER (PARTITION BY sym) AS c FROM y WHERE rn >= 27 AND c5 <> 0)
SELECT sym, CASE WHEN k < floor(c * 0.7::DOUBLE) THEN 'train' WHEN k < floor(c * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS part, target, count(*) AS n FROM z GROUP BY 1, 2, 3""")
add("score_batch", lambda s, d: shown(tr.score_batch(_forest(s, d), _part(s, d, "test")), "prob"), None)
add("train_random_forest", lambda s, d: rounded(tr.quality(tr.score_batch(_forest(s, d), _part(s, d, "test")))), None)
add("train_gbt", lambda s, d: rounded(tr.quality(_gbt(s, d))), None)


#: Forests and boosted trees of a search.
SPACE = {"model": ["forest", "boosted"], "trees": (6, 18), "depth": (2, 4)}


def _searched(s: SparkSession, d: str) -> DataFrame:
    """The best of six drawn models, each tried on half of the rows and trees first, a third of them on all."""
    trials = se.draw_trials(s, SPACE, 6)
    rungs = se.successive_halving(trials, se.fitted_trials(_rows(s, d), X, "auc"), rungs=2)
    return rounded(se.halving_winner(rungs, trials))


add("param_search", _searched, None)
add("grid_search", lambda s, d: rounded(mo.best_trial(tr.param_search(_rows(s, d), X, GRID, "auc"))), None)
add("walk_forward", lambda s, d: rounded(tr.walk_forward(_rows(s, d), _folds(s, d), X, GRID)), None)


def _held_out(s: SparkSession, d: str) -> DataFrame:
    """The rows of part test with positions of their own, from 0 in each symbol."""
    return cut(row_position(_part(s, d, "test").drop("rn")))


add("permutation_importance", lambda s, d: rounded(tr.permutation_importance(_forest(s, d), _held_out(s, d), X, 2)), None)


def _table_scores(s: SparkSession, d: str, boosted: bool) -> DataFrame:
    """How many held-out rows a symbol has, and how many of them a fitted model and the table of its nodes score apart."""
    rows = cut(_rows(s, d))
    model = tr.train_gbt(rows, X, rounds=5) if boosted else tr.train_random_forest(rows.where("part = 'train'"), X, trees=20)
    held = rows.where("part = 'test'")
    both = tr.score_batch(model, held).join(tt.score_nodes(tt.node_table(model, X), held, X, boosted).select("sym", "rn", F.col("prob").alias("other")), ["sym", "rn"], "full")
    apart = F.count_if(~F.coalesce(F.abs(F.col("prob") - F.col("other")) < 1e-9, F.lit(False)))
    return both.groupBy("sym").agg(F.count(F.lit(1)).alias("n"), apart.alias("apart"))


TEST_ROWS = f"SELECT sym, sum(n)::BIGINT AS n, 0::BIGINT AS apart FROM ({ORACLE_SQL['training_set']}) WHERE part = 'test' GROUP BY sym"
add("score_nodes_forest", lambda s, d: _table_scores(s, d, False), TEST_ROWS)
add("score_nodes_boosted", lambda s, d: _table_scores(s, d, True), TEST_ROWS)
#: A stored model of three trees over bars: tree, node, feature, threshold, left, right, value, weight.
STORED = [
    (0, 0, "roc_5", 0.0, 1, 2, 0.4, 1.0), (0, 1, "volume_osc", -5.0, 3, 4, 0.3, 1.0), (0, 2, None, None, None, None, 0.7, 1.0),
    (0, 3, None, None, None, None, 0.1, 1.0), (0, 4, None, None, None, None, 0.45, 1.0),
    (1, 0, "sma_10", 40.0, 1, 2, 0.5, 2.0), (1, 1, None, None, None, None, 0.35, 2.0), (1, 2, "sma_20", 45.0, 3, 4, 0.6, 2.0),
    (1, 3, None, None, None, None, 0.55, 2.0), (1, 4, "roc_5", 20.0, 5, 6, 0.8, 2.0), (1, 5, None, None, None, None, 0.65, 2.0), (1, 6, None, None, None, None, 0.9, 2.0),
    (2, 0, None, None, None, None, 0.5, 1.0),
]


def _stored(s: SparkSession, d: str, boosted: bool) -> DataFrame:
    return shown(tt.score_nodes(s.createDataFrame(STORED, tt.NODES), _features(s, d), X, boosted), "prob")


def _stored_sql(prob: str) -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(q, r)) + ")" for r in STORED)
    case = "CASE feature " + " ".join(f"WHEN '{c}' THEN {c}" for c in X) + " END"
    return f"""{BARS.replace("WITH ", "WITH RECURSIVE ", 1)}, {FEATURES},
nodes(tree, node, feature, threshold, l, r, value, weight) AS (VALUES {values}),
walk AS (SELECT f.*, n.* FROM f JOIN nodes n ON n.node = 0 UNION ALL
  SELECT w.sym, w.ts, {', '.join(f'w.{c}' for c in X)}, n.* FROM walk w JOIN nodes n ON w.feature IS NOT NULL AND n.tree = w.tree AND n.node = CASE WHEN {case.replace('feature', 'w.feature').replace('THEN ', 'THEN w.')} <= w.threshold THEN w.l ELSE w.r END)
SELECT sym, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round({prob}, 6) AS prob FROM walk WHERE feature IS NULL GROUP BY sym, walk.ts"""


def _features(s: SparkSession, d: str) -> DataFrame:
    return finite_indicators(positioned(s, d)).select("sym", "ts", *X).dropna()


FEATURES = f"""f0 AS (SELECT sym, ts, {_sma('close', 10)} AS sma_10, {_sma('close', 20)} AS sma_20, {_sma('volume', 14)} - {_sma('volume', 28)} AS volume_osc,
  100 * (close / nullif(lag(close, 5) OVER (PARTITION BY sym ORDER BY rn), 0) - 1) AS roc_5 FROM bars),
f AS (SELECT * FROM f0 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in X)})"""
add("score_stored_forest", lambda s, d: _stored(s, d, False), _stored_sql("sum(weight * value) / sum(weight)"))
add("score_stored_boosted", lambda s, d: _stored(s, d, True), _stored_sql("1 / (1 + exp(-2 * sum(weight * value)))"))

#: Rules of a search that SQL can follow: a least length of a text, and a weight of precision against recall.
RULES = {"least": ("log", 50.0, 5000.0), "beta": [0.5, 1.0, 2.0]}


def _rule_values(s: SparkSession, d: str):
    """Of each rule the F score of "long enough" for good documents, on a share of the labelled ones; all trials are counted in one job."""
    rows = _scored(s, d)

    def evaluate(trials: DataFrame, share: float) -> DataFrame:
        each = rows.where(se.in_share(share, "doc_id")).crossJoin(F.broadcast(trials))
        said, good, b2 = F.col("s") >= F.col("least"), F.col("y") == 1, F.col("beta") * F.col("beta")
        counts = each.groupBy("trial", "beta").agg(F.count_if(said & good).alias("tp"), F.count_if(said & ~good).alias("fp"), F.count_if(~said & good).alias("fn"))
        return counts.select("trial", F.try_divide((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp")).alias("value"))

    return evaluate


def _rule_search(s: SparkSession, d: str) -> DataFrame:
    return rounded(se.successive_halving(se.draw_trials(s, RULES, 18, "rules"), _rule_values(s, d)))


def _u(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _rule_sql() -> str:
    parts = [f"""t AS (SELECT trial, 50.0::DOUBLE * pow(100.0::DOUBLE, {_u("'rules:least:' || trial")}) AS least, [0.5, 1.0, 2.0][floor({_u("'rules:beta:' || trial")} * 3)::INTEGER + 1]::DOUBLE AS beta FROM range(18) r(trial))"""]
    for k in range(3):
        share = 3.0 ** (k - 2)
        of = "t" if not k else f"t SEMI JOIN r{k - 1} ON t.trial = r{k - 1}.trial AND r{k - 1}.promoted"
        parts.append(f"""c{k} AS (SELECT t.trial, beta * beta AS b2, count(*) FILTER (s >= least AND y = 1) AS tp, count(*) FILTER (s >= least AND y <> 1) AS fp, count(*) FILTER (s < least AND y = 1) AS fn
  FROM (SELECT * FROM {of}) t, (SELECT * FROM m WHERE {_u("'rows:' || doc_id")} < {share!r}::DOUBLE) GROUP BY t.trial, beta),
v{k} AS (SELECT trial, (1 + b2) * tp / nullif((1 + b2) * tp + b2 * fn + fp, 0) AS value, count(*) OVER () AS n FROM c{k}),
r{k} AS (SELECT {k} AS rung, trial, {share!r}::DOUBLE AS share, value, row_number() OVER (ORDER BY value DESC NULLS LAST, trial) <= greatest(1, n // 3) AND {str(k < 2).upper()} AS promoted FROM v{k})""")
    return SCORED.replace("SELECT quality", "SELECT doc_id, quality") + ", " + ", ".join(parts) + " SELECT rung, trial, round(share, 6) AS share, round(value, 6) AS value, promoted FROM (" + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(3)) + ")"


add("halving_rungs", _rule_search, _rule_sql())
