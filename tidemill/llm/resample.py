"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import id_remainder, materialize, sub_batches

#: Buckets of hashed n-grams, and most labelled documents that the target model is fitted on.
BUCKETS, TARGET_ROWS = 1 << 14, 20_000
#: A text weighs as if it had this many n-grams at most: without that, length decides, and the noise never matters.
TEMPER = 32
#: Bins of a round of counting, and distinct keys that are told to the driver at the end of it.
BINS, RANKED = 4096, 10_000


def buckets(text: str | None, size: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's words and pairs of neighbouring words (ASCII white space splits, A-Z is lower-cased)."""
    words = text.encode().lower().split() if text else []
    one = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words))
    two = (one[:-1] * 0x9E3779B1 + one[1:] * 0x85EBCA77 + 1) & 0xFFFFFFFF
    return np.concatenate([one, two ^ (two >> 15)]) % size


def bucket_counts(docs: DataFrame, size: int = BUCKETS) -> DataFrame:
    """``bucket, raw, target``: n-grams of all rows of ``text, target`` and of those whose target is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in sub_batches(batches):
            for text, is_target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.bincount(buckets(text, size), minlength=size)
                raw += n
                if is_target:
                    target += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    parts = docs.select("text", "target").mapInArrow(run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_weights(docs: DataFrame, ratio: np.ndarray, temper: float = TEMPER) -> DataFrame:
    """``doc_id, noise, log_weight`` of ``doc_id, noise, text``: the sum of the log ratios of a text's n-grams, scaled
    down to ``temper`` of them where it has more; null and empty texts have 0."""

    def weight(text: str | None) -> float:
        at = buckets(text, len(ratio))
        return float(ratio[at].sum() * min(1.0, temper / max(len(at), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches):
            w = [weight(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w, pa.float64())], ["doc_id", "noise", "log_weight"])

    return docs.select("doc_id", "noise", "text").mapInArrow(run, "doc_id long, noise double, log_weight double")


def cut_of(rows: DataFrame, key: Column, k: int, ranked: int = RANKED) -> tuple[float | None, int]:
    """The key of the k-th row in falling order, and the number of rows with a larger one. The place of the cut is found
    by counting in equal bins and again in the bin of the cut, until that has ``ranked`` rows at most or a single key;
    then its distinct keys are counted. Nothing is sorted, and the driver gets a bounded number of counts."""
    rows = rows.select(key.alias("key"))
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low is not None and low < high:
        width = (float(high) - float(low)) / BINS
        if width <= 0:
            break
        bin_ = F.least(F.floor((F.col("key").cast("double") - F.lit(float(low))) / F.lit(width)), F.lit(BINS - 1)).cast("int")
        inside = rows.where(F.col("key").between(low, high))
        bins = inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            low, high, n = r["lo"], r["hi"], r["n"]
            if above + n >= k:
                break
            above += n
        if n <= ranked:
            for value, n in sorted(map(tuple, rows.where(F.col("key").between(low, high)).groupBy("key").count().collect()), reverse=True):
                if above + n >= k:
                    return value, above
                above += n
    return low, above


def top_k(rows: DataFrame, key: str, id_col: str, k: int, ranked: int = RANKED) -> DataFrame:
    """``rows`` with ``kept``: true for exactly the k largest keys, the smaller id (null last) first of equal ones, any of
    rows that are alike in both. However many rows tie, they are only counted."""
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()))
    by_id = F.coalesce(-F.col(id_col), F.lit(-(2**63) + 1))
    kept, tied, left = F.lit(False), F.lit(True), k
    for level in (F.col(key), by_id, -F.col("__row")):
        value, above = cut_of(rows.where(tied), level, left, ranked) if left > 0 else (None, 0)
        if value is None:
            break
        kept, tied, left = kept | (tied & (level > value)), tied & (level == value), left - above
    else:
        kept = kept | tied
    return rows.withColumn("kept", kept).drop("__row")


def gumbel(id_col: str, text_col: str, seed: str = "gumbel") -> Column:
    """Standard Gumbel noise from the MD5 of seed, id and a hash of the text: the same in every run and on every
    machine, and of its own for each of the rows that share an id."""
    own = F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string"))
    bits = F.conv(F.substring(F.md5(own), 1, 12), 16, 10).cast("double")
    return -F.log(-F.log((bits + 0.5) / F.lit(float(1 << 48))))


def importance_resample(docs: DataFrame, target_ids: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS, size: int = BUCKETS, temper: float = TEMPER) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, log_weight, key, kept``.

    ``target_ids`` (``doc_id``) names the documents of the target; at most ``target_rows`` of them, those with the
    smallest hashes, teach its model, so the table that is broadcast to find them is bounded. The raw model counts
    the n-grams of all documents. Both are distributions over hashed words and word pairs with one added to each
    count; a document's weight is their ratio over its n-grams, tempered to ``temper`` of them. With Gumbel noise added
    to its logarithm the ``share`` of the documents with the largest keys is a sample without replacement in proportion
    to the weights. Null and empty texts have weight 1 and take part, as do rows with null or repeated ids, each on its
    own; without target ids all weights fall on the added ones; an empty table gives an empty result; other columns are
    ignored.
    """
    noise = gumbel(id_col, text_col).alias("noise")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), noise, F.col(text_col).alias("text"))
    target = target_ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("target", F.lit(True))
    counts = bucket_counts(base.join(F.broadcast(target), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target")), size).toPandas()
    raw, aim = np.ones(size), np.ones(size)
    raw[counts["bucket"]] += counts["raw"]
    aim[counts["bucket"]] += counts["target"]
    ratio = np.log(aim / aim.sum()) - np.log(raw / raw.sum())
    rows = log_weights(base, ratio, temper).select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key"))
    return top_k(rows, "key", "doc_id", round(docs.count() * share))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is documents labelled as good, less a fifth that is held out by the id's crc32; as large a share of all
    documents is kept as of the labelled ones is good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    share = labels.agg(F.avg("quality")).first()[0] or 0.0
    held = id_remainder("doc_id", 5) == 0
    chosen = importance_resample(docs, labels.where("quality = 1").where(~held), float(share))
    return chosen.withColumn("held_out", held)
