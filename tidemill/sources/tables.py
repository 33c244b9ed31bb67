"""Reading and writing the tables of series: Parquet, CSV, JSON lines, columnar JSON and exchange payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the fields of a bar as the exchange sends them, in order, and their types; the last one is dropped.
KLINE = [("open_time", "ms"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"), ("volume", "double"), ("close_time", "ms"), ("quote_asset_volume", "double"), ("number_of_trades", "bigint"), ("taker_buy_base_asset_volume", "double"), ("taker_buy_quote_asset_volume", "double"), ("ignore", None)]


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with a schema only its columns are read."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header line; values that don't fit the schema become null."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, since: str | None = None, column: str = "ts", period: str | None = None, now: str | None = None) -> DataFrame:
    """JSON lines, those at or after ``since`` if given, or of the ``period`` (day, week, month) of ``now`` (by default the
    current time) in the session's time zone."""
    rows = spark.read.schema(schema).json(path)
    kind = rows.schema[column].dataType
    if period:
        begin = F.date_trunc(period, F.lit(now).cast("timestamp") if now else F.current_timestamp())
        rows = rows.where(F.col(column) >= begin.cast(kind))
    return rows.where(F.col(column) >= F.lit(since).cast(kind)) if since else rows


def read_columnar_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Documents of equally long lists by column name, as rows; with ``lines`` each line is a document, so that a file can be
    split. Lists of different lengths raise."""
    doc = spark.read.schema(schema).option("multiLine", not lines).json(path)
    columns = doc.columns
    uneven = F.lit(False)
    for c in columns[1:]:
        uneven = uneven | ~F.size(c).eqNullSafe(F.size(columns[0]))
    checked = F.when(uneven, F.raise_error(F.lit("lists of different lengths"))).otherwise(F.arrays_zip(*columns))
    return doc.select(F.inline(checked))


def ms_to_ts(ms: Column) -> Column:
    """Milliseconds since 1970 as a timestamp without time zone."""
    zero = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return zero + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / 1000).cast("decimal(18,6)"))


def decode_klines(payloads: DataFrame, column: str = "value") -> DataFrame:
    """One row for each bar in JSON arrays of arrays of 12 positional fields; other columns stay. Payloads that aren't
    such arrays give no rows, and fields that aren't numbers are null."""
    bars = payloads.withColumn("__k", F.explode(F.from_json(column, "array<array<string>>")))
    fields = []
    for i, (name, kind) in enumerate(KLINE):
        value = F.get("__k", F.lit(i))
        if kind:
            fields.append((ms_to_ts(value.try_cast("bigint")) if kind == "ms" else value.try_cast(kind)).alias(name))
    return bars.select(*[c for c in payloads.columns if c != column], *fields)


def write_parquet(df: DataFrame, path: str, time: str = "ts", mode: str = "overwrite") -> None:
    """Parquet by symbol and day; only the partitions that ``df`` holds are replaced."""
    parts = df.withColumn("dt", F.to_date(time))
    parts.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("sym", "dt").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with ISO timestamps; nulls are written, and NaN as null."""
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_log(df: DataFrame, path: str, batch: str) -> None:
    """Adds events to a log of JSON lines, with an ``id`` that is a hash of ``batch`` (a name of this call) and the event: a
    task that runs again makes the same ids, and events that are alike share one."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns]
    df.withColumn("id", F.sha2(F.concat_ws("\x1f", F.lit(batch), *values), 256)).write.mode("append").json(path)


def append_dated_log(df: DataFrame, path: str, batch: str, time: str = "ts") -> None:
    """Adds events to a log kept by day (``dt=...`` folders), under a folder of the call's name: a call that runs again replaces what it
    wrote. Files of a day are few, as rows are dealt by day before they are written."""
    dated = df.withColumn("dt", F.to_date(time)).withColumn("batch", F.lit(batch))
    spread = dated.repartition("dt", F.pmod(F.xxhash64(*df.columns), F.lit(4)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").json(path)


def read_dated_log(spark: SparkSession, path: str, schema: str, period: str | None = None, now: str | None = None, time: str = "ts") -> DataFrame:
    """Events of a log of :func:`append_dated_log`, all or those of the ``period`` (day, week, month) of ``now`` (by default the current
    time): the days of other periods are not listed."""
    rows = spark.read.schema(f"{schema}, dt date, batch string").json(path)
    if period:
        begin = F.date_trunc(period, F.lit(now).cast("timestamp_ntz").cast("timestamp") if now else F.current_timestamp())
        rows = rows.where(F.col("dt") >= F.to_date(begin)).where(F.col(time) >= begin.cast(rows.schema[time].dataType))
    return rows.drop("dt", "batch")


#: Bytes of a file of a compacted log.
LOG_FILE = 128 << 20


def compact_log(spark: SparkSession, path: str, schema: str, before: str | None = None) -> None:
    """Writes each day of a log, those before a date if given, as one batch of files of about LOG_FILE bytes.

    The names of the batches to replace are written first, then the new batch under a hidden name; only when that is whole do
    the old ones go, and it takes its name. A run that was cut short is finished by the next one from those names, so nothing is lost
    or repeated, and batches that have come meanwhile stay. Readers should not run while a day's folders change."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda at: fs.exists(fs_path(at))
    names = lambda at, start: sorted(n for n in (s.getPath().getName() for s in fs.listStatus(fs_path(at))) if n.startswith(start)) if there(at) else []

    for day in names(path, "dt="):
        at = f"{path}/{day}"
        marked, new = f"{at}/_replaced", f"{at}/_new"
        if not there(f"{marked}/_SUCCESS"):
            old = names(at, "batch=")
            if before and day[3:] >= before or old in ([], ["batch=all"]):
                continue
            spark.createDataFrame([(b,) for b in old], "name string").coalesce(1).write.mode("overwrite").text(marked)
        old = [f"{at}/{r.value}" for r in spark.read.text(marked).collect() if there(f"{at}/{r.value}")]
        if not there(f"{new}/_SUCCESS") and old:
            size = sum(fs.getContentSummary(fs_path(b)).getLength() for b in old)
            spark.read.schema(schema).json(old).repartition(max(1, -(-size // LOG_FILE))).write.mode("overwrite").json(new)
        if there(f"{new}/_SUCCESS"):
            for b in old:
                fs.delete(fs_path(b), True)
            fs.rename(fs_path(new), fs_path(f"{at}/batch=all"))
        fs.delete(fs_path(marked), True)
