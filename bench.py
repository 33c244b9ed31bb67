"""Times the headline queries once each and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemill.plans.queries import QUERIES

HEADLINES = ["resample_ohlcv", "sma", "stoch", "ema", "macd", "asof_backward", "regime_volatility", "roc_auc", "equity_metrics", "dedup_keep_last"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()
    seconds = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
