"""Connected components of a link table by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import materialize, salted_join


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of the undirected graph whose links are the rows (a, b).

    Returns ``node, component`` (the smallest node id reachable) for every node that has a link to
    another node. Self links, nulls and repeated links are ignored; an empty table gives an empty result.

    Each round every node hooks onto its smallest neighbour, two pointer jumps flatten the trees, and the
    graph is contracted onto the parents. Rounds are logarithmic in the longest chain, nothing is collected
    but the count that ends the loop, and every look-up of a hub is salted.
    """
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    edges = materialize(edges)
    total = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        hook = materialize(hook.select("node", F.least("node", "m").alias("parent")))
        for _ in range(2):
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            hook = salted_join(hook, up, ["parent"]).select("node", F.col("grand").alias("parent"))
        hook = materialize(hook)
        if total is None:
            total = hook
        else:
            step = hook.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            total = salted_join(total, step, ["parent"], "left").select("node", F.coalesce("next", "parent").alias("parent"))
            total = materialize(total)
        as_a = hook.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        as_b = hook.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = salted_join(salted_join(edges, as_a, ["a"]), as_b, ["b"]).select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        chain = salted_join(hook.select(F.col("parent").alias("a")).distinct(), as_a, ["a"]).select("a", F.col("pa").alias("b"))
        new = moved.unionByName(chain).where("a <> b")
        edges = materialize(new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return total.select("node", F.col("parent").alias("component"))
