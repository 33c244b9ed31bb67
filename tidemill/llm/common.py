"""Helpers shared by the text operators: scratch tables, salted look-ups, sub-batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators define it: blank, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a session that runs in one process (as in
    tests) gets a temporary folder of its own; on a cluster, whose executors would not see that, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


#: Scratch folders of sessions in one process, by application.
_LOCAL: dict[str, str] = {}


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts lineage,
    survives lost executors and is computed a single time."""
    path = f"{scratch_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of the tables that :func:`materialize` wrote, by application.
_WRITTEN: dict[str, list[str]] = {}


def drop_scratch(spark: SparkSession) -> int:
    """Deletes the tables that this driver's operators have written to the scratch folder and returns their number. To be called
    when results are stored, as what an operator returned may still read them."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    fs_path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        fs_path(p).getFileSystem(conf).delete(fs_path(p), True)
    return len(paths)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Join with ``right`` unique on ``keys``; the rows of a hot key of ``left`` are spread over ``salts`` tasks."""
    rest = [c for c in left.columns if c not in keys] or keys
    one = left.withColumn("__salt", F.pmod(F.xxhash64(*rest), F.lit(salts)))
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return one.join(many, [*keys, "__salt"], how).drop("__salt")


def tiled(rows: DataFrame, keys: list[str], tile: int, alone: bool = False) -> DataFrame:
    """``rows`` dealt into groups ``*keys, i, j`` and sorted by them, for comparisons within each key. A key of more
    than ``tile`` rows is split by a hash of ``rep`` into tiles: a row's is ``own``, and each pair i <= j of tiles is a
    group. Rows without company are dropped. With ``alone`` they stay, each row is in its own tile only (i = j), and
    ``split`` tells whether its key has several.

    Keys are counted first (combined before the shuffle); the join with the counts is a plain one of two exchanges or
    a small table, so that Spark splits or avoids the shuffle of a hot key."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > (tile if alone else 1))
    counts = materialize(counts.select(*keys, F.ceil(F.col("c") / tile).cast("int").alias("tiles")))
    dealt = rows.join(counts, keys, "left" if alone else "inner")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.coalesce("tiles", F.lit(1))).cast("int"))
    if alone:
        dealt = dealt.withColumns({"i": F.col("own"), "j": F.col("own"), "split": F.col("tiles").isNotNull()})
    else:
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")
    return dealt.drop("tiles").repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def whole_groups(solve: Callable[[pd.DataFrame], pd.DataFrame], by: list[str]) -> Callable:
    """A function for ``mapInPandas`` that hands ``solve`` frames of rows sorted by ``by`` with no group cut in two;
    what it holds back of a batch is the last group, which :func:`tiled` bounds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            last = pdf[by].iloc[-1]
            cut = int(np.argmax((pdf[by] == last).all(axis=1).to_numpy()))
            if cut or (held and (held[-1][by].iloc[-1] != last).any()):
                yield solve(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def slot_map(slots: DataFrame) -> DataFrame:
    """``word, bits``: the column ``slot`` as bits of 64-bit words."""
    bit = F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))")
    return slots.groupBy(F.expr("slot div 64").alias("word")).agg(bit.alias("bits"))


def marked(rows: DataFrame, slot: Column, slots: DataFrame) -> DataFrame:
    """``rows`` with ``__marked``, whether their slot is in the map ``slots`` (a null slot is not). The map's size is
    that of the slots' range, which bounds its broadcast for any input."""
    at = rows.withColumn("__slot", slot).withColumn("__word", F.expr("__slot div 64"))
    found = at.join(F.broadcast(slots.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))), "__word", "left")
    bit = F.expr("coalesce(__bits & shiftleft(1L, cast(__slot % 64 as int)), 0L) <> 0")
    return found.withColumn("__marked", bit).drop("__word", "__slot", "__bits")


def id_remainder(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def sub_batches(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 2_000_000, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``chars`` bytes of text at most (or one row)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > chars or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def finite_vectors(column: pa.ListArray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and components ``floor(scale * x)`` (whole doubles) of the rows of an array of lists of doubles, by
    length of the list. Rows that are null or hold a null or non-finite component don't come out. Components beyond
    4,096 in size raise: products and squares of larger ones would not stay exact."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), -1)
    for dim in np.unique(size[size >= 0]).tolist():
        at = np.nonzero(size == dim)[0]
        x = flat[ends[at][:, None] + np.arange(dim, dtype=np.int64)].astype(np.float64)
        good = np.isfinite(x).all(axis=1)
        if (np.abs(x[good]) > 4096).any():
            raise ValueError("a vector has a component beyond 4,096")
        yield at[good], np.floor(x[good] * scale)


def packed_rows(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers as binary values of 32-bit integers; :func:`unpacked_rows` is the way back."""
    return pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())


def unpacked_rows(column: pa.Array) -> np.ndarray:
    """The matrix (doubles) of binary values of one length."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype="<i4").reshape(len(rows), -1).astype(np.float64)
