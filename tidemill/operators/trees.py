"""Fitted trees as tables of nodes, and rows scored by such a table."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.core import cut, scratch_root

#: Columns of a node table. Leaves have a null ``feature``; ``value`` is what a tree says at a node: a forest's share of class 1,
#: a boosted tree's part of the margin. ``weight`` is the tree's.
NODES = "tree int, node int, feature string, threshold double, left int, right int, value double, weight double"


def node_table(model: PipelineModel, columns: list[str]) -> DataFrame:
    """The nodes (:data:`NODES`) of the trees of a model's last stage, a forest or boosted trees on ``columns``. The table is read from
    the model's own files, which Spark writes, and kept; a model is as many rows as its trees have nodes, whatever it was fitted on."""
    trees = model.stages[-1]
    if not isinstance(trees, RandomForestClassificationModel | GBTClassificationModel):
        raise TypeError(f"{type(trees).__name__} has no trees")
    spark = SparkSession.active()
    path = f"{scratch_root(spark)}/trees-{uuid.uuid4().hex}"
    trees.write().overwrite().save(path)
    forest = isinstance(trees, RandomForestClassificationModel)
    n = F.col("nodeData")
    stats = n["impurityStats"]
    value = F.try_divide(stats[1], stats[0] + stats[1]) if forest else n["prediction"]
    names, weights = F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(float(w)) for w in trees.treeWeights])
    split = n["split"]
    inner = n["leftChild"] >= 0
    return cut(
        spark.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(inner, F.get(names, split["featureIndex"])).alias("feature"),
            F.when(inner, split["leftCategoriesOrThreshold"][0]).alias("threshold"), F.when(inner, n["leftChild"]).alias("left"),
            F.when(inner, n["rightChild"]).alias("right"), value.alias("value"), F.get(weights, F.col("treeID")).alias("weight"),
        ),
    )


def _walk(tree: Column, x: Column) -> Column:
    """The value of the leaf that a row of features ``x`` (an array in the order of the table's features) reaches in a tree's arrays."""
    leaf = lambda k: tree["feature"][k] < 0
    down = lambda k: F.when(x[tree["feature"][k]] <= tree["threshold"][k], tree["left"][k]).otherwise(tree["right"][k])
    at = F.aggregate(F.sequence(F.lit(1), tree["depth"]), F.lit(0), lambda k, _: F.when(leaf(k), k).otherwise(down(k)))
    return tree["value"][at]


def score_nodes(nodes: DataFrame, rows: DataFrame, columns: list[str], boosted: bool = False) -> DataFrame:
    """``rows`` with ``prob``, the probability of class 1 by the trees of a node table over ``columns``: the weighted mean of a forest's
    leaves, or for ``boosted`` trees the logistic function of twice the sum. Rows with a null or NaN feature fall away, and without trees there
    are none.

    A tree becomes one row of arrays, all trees one row that goes to every task (as large as the model). A row walks each tree
    inside of one expression, a step a level, so nothing is joined by row and no row is multiplied by trees."""
    order = F.array(*[F.lit(c) for c in columns])
    numbered = nodes.select("tree", "node", "weight", F.struct(
        "node", (F.coalesce(F.array_position(order, F.col("feature")), F.lit(0)) - 1).cast("int").alias("feature"), "threshold", "left", "right", "value",
    ).alias("n"))
    # Node numbers are dense from 0 in each tree, so a node's number is its place; a path is no longer than half of the nodes.
    per = numbered.groupBy("tree").agg(F.array_sort(F.collect_list("n")).alias("n"), F.max("weight").alias("weight"))
    fields = [F.col(f"n.{c}").alias(c) for c in ("feature", "threshold", "left", "right", "value")]
    trees = per.select(F.struct("tree", "weight", ((F.size("n") + 1) / 2).cast("int").alias("depth"), *fields).alias("t"))
    model = trees.agg(F.array_sort(F.collect_list("t")).alias("__trees")).where("size(__trees) > 0")
    x = F.array(*[F.col(c).cast("double") for c in columns])
    whole = rows.where(~F.exists(x, lambda v: v.isNull() | F.isnan(v))).withColumn("__x", x).crossJoin(F.broadcast(model))
    total = lambda what: F.aggregate("__trees", F.lit(0.0), lambda acc, t: acc + what(t))
    said = total(lambda t: t["weight"] * _walk(t, F.col("__x")))
    prob = 1 / (1 + F.exp(-2 * said)) if boosted else said / total(lambda t: t["weight"])
    return whole.withColumn("prob", prob).select(*rows.columns, "prob")
