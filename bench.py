"""Time the headline queries on local Spark and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and
cores. Every query is written to the noop sink in full; ``value`` is the sum of seconds.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "raw_range_scan", "raw_normalise", "raw_latest_wins", "recent_rows", "multi_source_align",
    "lag_features", "rolling_stats", "rolling_stats_hot_series", "rsi", "ewm_mean", "macd", "bollinger", "momentum_roc",
    "forward_fill", "sentiment_window", "out_of_order_rows", "missing_dates", "price_indicators", "feature_frame",
    "numeric_profile", "iqr_fences", "correlation_pairs", "duplicate_rows", "category_profile",
    "raw_validation", "feature_validation", "score_quality",
    "metric_windows", "metric_durations", "naive_forecast", "top_contributions", "feature_vector_pack",
    "stream_ingest_upsert", "raw_upsert_merge",
]


def run(spark: SparkSession, fn, sf: str) -> float:
    start = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from catalog import QUERIES

    run(spark, QUERIES["price_indicators"], sf)
    seconds = {name: round(run(spark, QUERIES[name], sf), 3) for name in HEADLINE}
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "ingest_records_per_minute": round(events / seconds["stream_ingest_upsert"] * 60),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
