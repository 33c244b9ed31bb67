"""Streams whose batches meet a stored table: upserts, monitoring, late rows and recurrent indicators; joins of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.core import cut, recurrences, row_position
from tidemill.operators.models import monitoring_alerts


def each_batch(stream: DataFrame, folder: str, run: Callable[[DataFrame, int], None]) -> None:
    """Runs what there is of a stream batch by batch, with its checkpoint under ``folder``. A batch may run again after a
    failure, so ``run`` writes results under the batch's number or replaces what it touched."""
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _stored(like: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, empty if nothing has been written."""
    spark = like.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path)


def stream_upsert(stream: DataFrame, folder: str, keys: tuple[str, ...] = ("sym", "ts"), newest: str = "loaded") -> str:
    """Merges a stream into the table ``folder/rows``, kept by day: of rows with equal ``keys`` the one with the largest
    ``newest`` stays, of equally new ones the one with the largest other columns. Only days that a batch touches are read and replaced. Returns the table's path."""
    path = f"{folder}/rows"

    def run(batch: DataFrame, _: int) -> None:
        rows = cut(batch.withColumn("dt", F.to_date("ts")))
        old = _stored(rows, path).join(F.broadcast(rows.select("dt").distinct()), "dt", "left_semi").select(*rows.columns)
        best = old.unionByName(rows).groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(newest, *[c for c in rows.columns if c != newest])).alias("r")).select("r.*")
        cut(best).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)

    each_batch(stream, folder, run)
    return path


def stream_late_rows(stream: DataFrame, folder: str, late: str = "1 hour") -> tuple[str, str]:
    """Splits a stream into rows in time and rows that are more than ``late`` older than the latest row of the batches
    before (``folder/rows`` and ``folder/late``, by batch). Returns both paths."""
    rows, behind, marks = f"{folder}/rows", f"{folder}/late", f"{folder}/marks"

    def run(batch: DataFrame, number: int) -> None:
        top = batch.agg(F.max("ts").alias("top")).withColumn("batch", F.lit(number).cast("long"))
        mark = _stored(top, marks).where(F.col("batch") < number).agg(F.max("top").alias("__top"))
        old = F.coalesce(F.col("ts") < F.col("__top") - F.expr(f"interval {late}"), F.lit(False))
        seen = batch.crossJoin(F.broadcast(mark)).withColumn("__late", old)
        for path, take in ((rows, ~F.col("__late")), (behind, F.col("__late"))):
            seen.where(take).drop("__top", "__late").write.mode("overwrite").parquet(f"{path}/batch={number}")
        top.drop("batch").write.mode("overwrite").parquet(f"{marks}/batch={number}")

    each_batch(stream, folder, run)
    return rows, behind


def stream_recurrences(stream: DataFrame, folder: str, means: dict[str, tuple[str, float]]) -> str:
    """Recurrent means (name: source column and alpha) of a stream of ``sym, ts``, in order of time across batches. Each batch
    goes on from the last values of each symbol, so nothing older is read. A row that is not after its symbol's state came
    too late for it: its means are null, and it changes no state. Returns the path of ``sym, ts``, sources and means."""
    out, states = f"{folder}/rows", f"{folder}/states"
    sources = list(dict.fromkeys(x for x, _ in means.values()))
    feeds = {f"__f{k}": (x, y, alpha) for k, (y, (x, alpha)) in enumerate(means.items())}

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.select("sym", "ts", *[F.col(x).cast("double").alias(x) for x in sources])
        like = rows.select("sym", "ts", *[F.lit(0.0).alias(y) for y in means], F.lit(0).cast("long").alias("batch"))
        state = cut(_stored(like, states).where(F.col("batch") == number - 1).drop("batch"))
        since = rows.join(state.select("sym", F.col("ts").alias("__since")), "sym", "left")
        late = F.coalesce(F.col("ts") <= F.col("__since"), F.lit(False))
        new = since.where(~late).select("sym", "ts", *sources, *[F.col(x).alias(f) for f, (x, _, _) in feeds.items()], F.lit(False).alias("known"))
        before = state.select(
            "sym", "ts", *[F.lit(None).cast("double").alias(x) for x in sources],
            *[F.col(y).alias(f) for f, (_, y, _) in feeds.items()], F.lit(True).alias("known"),
        )
        done = cut(recurrences(row_position(new.unionByName(before), "hour"), {y: (f, alpha) for f, (_, y, alpha) in feeds.items()}))
        found = done.where("not known").select("sym", "ts", *sources, *means)
        behind = since.where(late).select("sym", "ts", *sources, *[F.lit(None).cast("double").alias(y) for y in means])
        found.unionByName(behind).write.mode("overwrite").parquet(f"{out}/batch={number}")
        last = done.groupBy("sym").agg(F.max("ts").alias("ts"), *[F.max_by(y, "ts").alias(y) for y in means])
        kept = last.unionByName(state.join(last.select("sym"), "sym", "left_anti").select(*last.columns))
        kept.write.mode("overwrite").parquet(f"{states}/batch={number}")

    each_batch(stream, folder, run)
    return out


def stream_ema(stream: DataFrame, folder: str, n: int, column: str) -> str:
    """Exponential means of span ``n``: :func:`stream_recurrences` of one column. Returns the path of ``sym, ts, ema``."""
    return stream_recurrences(stream, folder, {"ema": (column, 2.0 / (n + 1))})


def stream_wilder(stream: DataFrame, folder: str, n: int, columns: list[str]) -> str:
    """Wilder means ``wilder_<column>`` of several columns, as for ATR, RSI or ADX of bars with their moves."""
    return stream_recurrences(stream, folder, {f"wilder_{c}": (c, 1.0 / n) for c in columns})


def stream_monitoring(matched: DataFrame, folder: str, period: str = "day", least: float = 0.7, every: int = 32) -> str:
    """Alerts of the periods whose accuracy is under ``least``, over all matched predictions of a period that have come so
    far: a batch adds its sums to those stored and alerts on the periods that it touched. Every ``every`` batches the sums so far
    are written as one table, so a batch reads that and the sums of fewer than ``every`` batches. Returns the path of the alerts,
    ``kind, subject, value, batch``; a period's last batch has its last figure."""
    alerts, sums, wholes = f"{folder}/alerts", f"{folder}/sums", f"{folder}/wholes"

    def run(batch: DataFrame, number: int) -> None:
        right = F.when(F.col("actual").isNotNull(), (F.col("prediction") == F.col("actual")).cast("long"))
        own = batch.groupBy(F.date_trunc(period, "ts").alias("period")).agg(F.sum(right).alias("right"), F.count(right).alias("known"))
        own = cut(own.withColumn("batch", F.lit(number).cast("long")))
        own.drop("batch").write.mode("overwrite").parquet(f"{sums}/batch={number}")
        # Only what earlier batches wrote counts, so a batch that runs again finds what it found before.
        whole = _stored(own, wholes).where(F.col("batch") < number)
        base = whole.agg(F.max("batch")).first()[0]
        base = -1 if base is None else base
        rest = _stored(own, sums).where((F.col("batch") > base) & (F.col("batch") < number))
        before = whole.where(F.col("batch") == base).unionByName(rest)
        touched = before.join(own.select("period"), "period", "left_semi").select(*own.columns).unionByName(own)
        both = touched.groupBy("period").agg(F.try_divide(F.sum("right"), F.sum("known")).alias("accuracy"))
        monitoring_alerts(both, least=least).write.mode("overwrite").parquet(f"{alerts}/batch={number}")
        if number % every == every - 1:
            all_sums = before.unionByName(own).groupBy("period").agg(F.sum("right").alias("right"), F.sum("known").alias("known"))
            all_sums.write.mode("overwrite").parquet(f"{wholes}/batch={number}")

    each_batch(matched, folder, run)
    return alerts


def stream_outcome_join(predictions: DataFrame, outcomes: DataFrame, within: str = "1 day") -> DataFrame:
    """Predictions (``id, ts, prediction``) with outcomes (``id, ts, actual``) that come at most ``within`` later; without
    one, ``actual`` is null and the row comes out when the watermark has passed."""
    p = predictions.withWatermark("ts", within).alias("p")
    o = outcomes.select(F.col("id").alias("oid"), F.col("ts").alias("at"), "actual").withWatermark("at", within)
    return p.join(o, F.expr(f"id = oid and at >= ts and at <= ts + interval {within}"), "leftOuter").select("id", "ts", "prediction", "actual")
