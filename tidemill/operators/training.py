"""Training sets, models and searches on Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators.core import cut, row_position
from tidemill.operators.learning import fold_rows, forward_max_target, split_time
from tidemill.operators.metrics import classification_metrics, roc_auc

def training_set(features: DataFrame, columns: list[str], window: int = 60, threshold: float = 500.0) -> DataFrame:
    """``sym, ts, rn``, ``columns``, ``target`` and ``part`` (train, val, test in time order) of the rows without nulls."""
    whole = forward_max_target(features, window, threshold).dropna(subset=columns)
    return split_time(row_position(whole.select("sym", "ts", *columns, "target")))


def feature_pipeline(columns: list[str], scaled: bool = True) -> list:
    """Stages that gather ``columns`` into ``features``, scaled by the statistics of the rows they are fitted on."""
    if not scaled:
        return [VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")]
    return [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def train_random_forest(train: DataFrame, columns: list[str], trees: int = 100, depth: int = 5, seed: int = 42) -> PipelineModel:
    forest = RandomForestClassifier(labelCol="target", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*feature_pipeline(columns, scaled=False), forest]).fit(train)


def train_gbt(labelled: DataFrame, columns: list[str], rounds: int = 20, depth: int = 3, seed: int = 42) -> PipelineModel:
    """Boosted trees fitted on rows of part train; rounds stop when rows of part val no longer gain."""
    rows = labelled.where("part in ('train', 'val')").withColumn("held", F.col("part") == "val")
    boost = GBTClassifier(labelCol="target", maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol="held", validationTol=0.001)
    return Pipeline(stages=[*feature_pipeline(columns, scaled=False), boost]).fit(rows)


def score_batch(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prob``, the probability of class 1; rows with nulls in the features fall away."""
    out = model.transform(rows)
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("prob"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_models(paths: dict[str, str]) -> dict[str, PipelineModel]:
    """The models that exist, by name; absent ones are skipped, broken ones raise."""
    spark = SparkSession.active()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = {n: p for n, p in paths.items() if path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(p))}
    return {n: PipelineModel.load(p) for n, p in there.items()}


def quality(scored: DataFrame, auc: bool = False) -> DataFrame:
    """accuracy, precision, recall and f1 at a probability of 0.5, and with ``auc`` the area under the ROC curve."""
    found = classification_metrics(scored.withColumn("said", (F.col("prob") > 0.5).cast("int")), "target", "said")
    return found.crossJoin(F.broadcast(roc_auc(scored, "target", "prob"))) if auc else found


def walk_forward(labelled: DataFrame, folds: DataFrame, columns: list[str], grid: list[dict], fit=train_random_forest) -> DataFrame:
    """``params, fold`` and the quality on the fold's test rows, for each set of parameters and fold: fitted on its
    train rows. Fold numbers, a handful, come to the driver, which starts one fit each."""
    rows = cut(fold_rows(labelled, folds))
    cells = []
    for k in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):
        one = rows.where(F.col("fold") == k)
        for params in grid:
            model = fit(one.where("role = 'train'"), columns, **params)
            cells.append(quality(score_batch(model, one.where("role = 'test'"))).select(F.lit(str(params)).alias("params"), F.lit(k).alias("fold"), "*"))
    return reduce(DataFrame.unionByName, cells)


def param_search(labelled: DataFrame, columns: list[str], grid: list[dict], metric: str = "accuracy", fit=train_random_forest) -> DataFrame:
    """Trials (``trial, state, value, parameters``): each set of parameters fitted on part train, measured on part val."""
    rows = cut(labelled)
    trials = []
    for k, params in enumerate(grid):
        scored = score_batch(fit(rows.where("part = 'train'"), columns, **params), rows.where("part = 'val'"))
        trials.append(quality(scored, metric == "auc").select(F.lit(k).alias("trial"), F.lit("COMPLETE").alias("state"), F.col(metric).alias("value"), F.lit(str(params)).alias("parameters")))
    return reduce(DataFrame.unionByName, trials)


def permuted(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """``rows`` (``sym, rn`` from 0 without gaps) with ``column`` moved between rows of a symbol: its values in the order of
    a hash of their positions and ``seed`` go to positions 0, 1, ... A hash's leading bits cut it into ranges, which
    are counted and ordered apart, so no symbol is ordered in one task."""
    h = F.xxhash64(F.lit(seed), "sym", "rn")
    each = rows.select("sym", F.col(column).alias("__v"), h.alias("h"), F.shiftrightunsigned(h, 52).alias("r"), F.col("rn").alias("o"))
    counts = each.groupBy("sym", "r").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("sym").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("sym", "r", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("sym", "r").orderBy("h", "o")) - 1
    moved = each.withColumn("k", inside).join(starts, ["sym", "r"]).select("sym", (F.col("start") + F.col("k")).alias("rn"), "__v")
    return rows.join(moved, ["sym", "rn"]).withColumn(column, F.col("__v")).select(*rows.columns)


def permutation_importance(model: PipelineModel, rows: DataFrame, columns: list[str], repeats: int = 5) -> DataFrame:
    """``feature, importance``: the mean fall of accuracy when one column's values are moved between rows."""
    base = quality(score_batch(model, rows)).select(F.col("accuracy").alias("base"))
    runs = [quality(score_batch(model, permuted(rows, c, r + 1))).select(F.lit(c).alias("feature"), "accuracy") for c in columns for r in range(repeats)]
    each = reduce(DataFrame.unionByName, runs).groupBy("feature").agg(F.avg("accuracy").alias("a"))
    return each.crossJoin(F.broadcast(base)).select("feature", (F.col("base") - F.col("a")).alias("importance"))
