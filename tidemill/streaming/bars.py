"""Streams of ticks: bars that close with the watermark, and rows without repetition."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.bars import resample_ohlcv
from tidemill.operators.core import scratch_root


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events at ``path`` (a folder or a pattern) as a stream of ticks."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.select(F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def stream_ohlcv(stream: DataFrame, rule: str, late: str = "1 hour") -> DataFrame:
    """Bars, each given out once when the watermark has passed its end; ticks later than ``late`` don't count."""
    return resample_ohlcv(stream.withWatermark("ts", late), rule)


def stream_dedup(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def new_folder(spark: SparkSession, folder: str | None = None) -> str:
    """A new name under ``folder``, by default that of ``spark.checkpoint.dir`` (:func:`scratch_root`)."""
    return f"{folder or scratch_root(spark)}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs the stream over what there is, into Parquet with a checkpoint under ``folder``, and reads the result."""
    at = new_folder(stream.sparkSession, folder)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
