"""Mixing sources to target weights with distributed prefix sums over hash-random keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import materialize

#: Weights that sources take in turn, the share of all words that the mix holds, and the most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents of one bucket of keys, within which the prefix sum is one window.
BUCKET_ROWS = 500
#: Most ranges of a source: those of the leading 32 bits of the key.
RANGES = 1 << 32


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix_key(id_col: str, text_col: str, seed: str) -> Column:
    """The random order of documents: a hash of seed and id, and of the text where the id is null, so that rows without ids
    don't share one key."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.hex(F.xxhash64(text_col))))))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: sources in code point order, null last, take the
    weights in turn; no target exceeds ``epochs`` times its source, and what is over is shared again by weight.

    The fixed point of that sharing is min(cap, level * weight): sources fill up in the order of cap / weight, and
    the level is what the rest divides. The table has one row per source, made from one counted row each.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", turn).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(fill), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
    t = t.withColumn("all_w", F.sum("w").over(whole)).withColumn("goal", F.sum("source_size").over(whole) * F.lit(float(share)))
    # The level if this source is the first that does not fill up; the first that holds is the answer.
    t = t.withColumn("level", (F.col("goal") - F.col("full")) / (F.col("all_w") - F.col("used")))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("o"), "source", "level"))).over(whole)
    t = t.withColumn("level", first["level"])
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def plan_mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, epochs: float, seed: str, bucket_rows: int) -> DataFrame:
    """``doc_id, size, key, tie, name, source_size, target, whole, rest`` of each row: whole epochs of its source, and
    the words of the epoch in part that are left when its turn comes."""
    key = mix_key(id_col, text_col, seed)
    named = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), named.alias("name"), n_words(text_col).alias("size"),
        key.alias("key"), F.xxhash64(text_col).alias("tie"),
    )
    d = materialize(d)
    stats = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(stats, weights, share, epochs)
    # Ranges are the leading bits of the key, grouped evenly; their number follows the table, not one source.
    ranges = min(max(-(-d.count() // bucket_rows), 1), RANGES)
    lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    cut = d.drop("source").withColumn("bucket", F.floor(lead * F.lit(ranges / (1 << 32))).cast("long"))
    sums = cut.groupBy("name", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("name", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("name")
    plan = materialize(starts.join(goals.select(named, "source_size", "target"), "name"))
    inner = Window.partitionBy("name", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(plan, ["name", "bucket"])
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("whole", whole)
    rest = budget - F.col("whole") * F.col("source_size") - F.col("start") - F.col("inside")
    return rows.select("doc_id", "size", "key", "tie", "name", "source_size", "target", "whole", rest.alias("rest"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``.

    ``size`` counts the words of the text (null: 0) and ``taken`` those the mix takes: the source's whole epochs,
    then the documents in the order of a hash of id and seed until the words of a rounded target are used up; the
    last one is taken in part, so that a source's words equal its target to half a word. The hash depends on
    nothing but id (text where that is null) and seed, so runs agree. Null is a source of its own; empty texts take nothing; an empty table
    gives an empty result. Rows with equal or null ids count each, in the order of a hash of their texts; rows that
    are alike in both differ in nothing but which of them is cut. Other columns are ignored.

    The hash range of each source is cut into about ``rows / bucket_rows`` ranges. Words are summed per range
    (combined before the shuffle), the ranges' prefix sums are taken over those few rows, and only then does a
    window order the rows of one range. A source with a third of all rows is thus spread over many ranges.
    """
    rows = plan_mix(docs, id_col, text_col, source_col, weights, share, epochs, seed, bucket_rows)
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest")))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mix as documents: a document comes once for each epoch that takes any of its words, whole each time, with
    all its columns; what the mix takes nothing of goes, and with it texts without words. An epoch's last document of
    a source is not cut, so a source is over its target by less than one document, or by less than the rows that
    repeat that one's id and text. An empty table gives an empty one.

    The plan is reduced to one row a source, its whole epochs and the last (key, id, text hash) that the epoch in part
    reaches. Documents are compared with that row in one scan; their texts are never shuffled.
    """
    rows = plan_mix(docs, id_col, text_col, source_col, weights, share, epochs, seed, bucket_rows)
    place = F.struct("key", F.col("doc_id").alias("id"), "tie")
    ends = rows.groupBy("name").agg(F.max("whole").alias("whole"), F.max(F.when((F.col("rest") > 0) & (F.col("size") > 0), place)).alias("last"))
    ends = materialize(ends)
    key = mix_key(id_col, text_col, seed)
    named = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    own = F.struct(key.alias("key"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"))
    each = docs.select(F.struct("*").alias("row"), named.alias("name"), own.alias("own"), (n_words(text_col) > 0).alias("some"))
    times = F.col("whole") + F.when(F.col("own") <= F.col("last"), 1).otherwise(0)
    copies = each.join(ends, "name").where("some").withColumn("times", times).where("times > 0")
    return copies.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"), "row").select("row.*").select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of 150 % of all words takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Levels of the targets are found by trying how many sources, in the order of cap / weight, are full.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix:' || doc_id::VARCHAR) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w,
             2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER r, 0) AS fullcap, coalesce(sum(w) OVER r, 0) AS used,
             sum(w) OVER () AS all_w, 1.5::DOUBLE * sum(source_size) OVER () AS goal
      FROM w WINDOW r AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (goal - fullcap) / (all_w - used) AS level FROM f),
g AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT arg_min(level, (cap / w, source IS NULL, source)) FROM l WHERE level * w <= cap), cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, round(g.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
             + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
