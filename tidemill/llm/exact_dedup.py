"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import SPACES, marked, materialize, slot_map

#: Code points of the normalised text that the prefix hash covers.
PREFIX_CHARS = 256
#: Slots of the bit maps of surviving lengths and (length, prefix hash) pairs.
SLOTS = 1 << 22


def normalized(text: str | Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def refined(rows: DataFrame, text_col: str, prefix_chars: int = PREFIX_CHARS, slots: int = SLOTS, hashed: bool = False) -> DataFrame:
    """``rows`` with ``full``: the SHA-256 of the normalised text where another row may have the same one, null where
    its length, or its length and the hash of its first ``prefix_chars`` code points, is nobody else's. With ``hashed``
    there is ``text_sha256`` as well, of every row.

    Lengths are counted first; only texts of a shared length have their beginning hashed and counted, and only those
    that share that too are hashed in full. Shared keys of both levels are told to the next scan by a bit map of
    ``slots`` bits, the only broadcast, of a fixed size for any input; a slot shared by chance costs one hash and
    changes nothing. Counts are combined before each shuffle.
    """
    # A column of its own, so that a scan normalises each text once.
    norm, size = F.col("__norm"), F.length("__norm")
    head = F.xxhash64(size, F.substring(norm, 1, prefix_chars))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    shared = lambda keys: materialize(slot_map(keys.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(slot("k").alias("slot"))))
    texts = rows.select(normalized(text_col).alias("__norm"))
    lengths = shared(texts.select(size.alias("k")))
    heads = shared(marked(texts, slot(size), lengths).where("__marked").select(head.alias("k")))
    left = marked(rows.withColumn("__norm", normalized(text_col)), slot(size), lengths).withColumnRenamed("__marked", "__sized")
    left = marked(left, F.when(F.col("__sized"), slot(head)), heads)
    digest = F.sha2(norm.cast("binary"), 256)
    if hashed:
        left, digest = left.withColumn("text_sha256", digest), F.col("text_sha256")
    return left.withColumn("full", F.when(F.col("__marked"), digest)).drop("__norm", "__sized", "__marked")


def rank(points: str, doc_id: str, *more: str) -> Column:
    """Of equal texts the one with the smallest of these stays: most code points, smallest id, null last."""
    return F.struct((-F.col(points)).alias("p"), F.col(doc_id).isNull().alias("o"), F.col(doc_id).alias("id"), *more)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, hashed: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept``, and with ``hashed`` ``text_sha256``.

    Texts are equal when identical after white space is deleted; of equal texts the one with the most code
    points in the original text, then the smallest id (null last), stays. Null and empty texts form one group. Other
    columns of ``docs`` are ignored and an empty table gives an empty result. A row that repeats another's id and
    text counts in the group and comes out again, and one of them is kept.

    Texts are told apart by :func:`refined`. What it leaves is written once without texts, with a number for each row
    that tells repeated ones apart; groups are counted with map-side combining and joined back by their hash, which is
    a plain equi-join of two exchanges, whose hot keys Spark splits.
    """
    out = ["text_sha256"] if hashed else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    points = F.length(F.coalesce("text", F.lit(""))).alias("points")
    keyed = refined(rows, "text", prefix_chars, hashed=hashed).select("doc_id", points, "full", F.monotonically_increasing_id().alias("key"), *out)
    keyed = materialize(keyed)
    one = F.lit(1).cast("long")
    alone = keyed.where("full is null").select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), *out)
    many = keyed.where("full is not null")
    groups = many.groupBy("full").agg(F.min(rank("points", "doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.select("full", F.col("first.id").alias("keep_id"), F.col("first.key").alias("keep_key"), "group_size"))
    rest = many.join(groups, "full").select("doc_id", "keep_id", "group_size", (F.col("key") == F.col("keep_key")).alias("kept"), *out)
    return alone.unionByName(rest)


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that :func:`exact_dedup` keeps, with all their columns: of equal texts one row, also where rows
    repeat each other or ids are null; an empty table gives an empty one.

    A document whose text nobody shares passes without a shuffle. Of the others the row that stays is the result of
    one aggregation, combined before its shuffle, so that a hot text moves one row a task.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = refined(rows, "text").select("row", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), "full")
    alone = keyed.where("full is null").select("row.*")
    kept = keyed.where("full is not null").groupBy("full").agg(F.min_by("row", rank("points", "doc_id")).alias("row"))
    return alone.unionByName(kept.select("row.*")).select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal without white space, the longest of each kept."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), hashed=True)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
