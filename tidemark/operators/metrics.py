"""Analytics on metric events ``(name, ts, value, labels...)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import join_same_key
from tidemark.operators.quantiles import exact_quantiles

# Upper bounds of the duration histogram, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def metric_counters(events: DataFrame, labels: Sequence[str] = (), name: str = "name",
                    value: str = "value") -> DataFrame:
    """Events and summed value per metric and labels."""
    return events.groupBy(name, *labels).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))


def metric_gauges(events: DataFrame, labels: Sequence[str] = (), name: str = "name", value: str = "value",
                  ts: str = "ts", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Last value per metric and labels; ties by ``tiebreak``."""
    if not tiebreak:
        return events.groupBy(name, *labels).agg(F.max_by(value, ts).alias("value"), F.max(ts).alias("ts"))
    last = F.max(F.struct(ts, *tiebreak, value)).alias("m")
    return events.groupBy(name, *labels).agg(last).select(
        name, *labels, F.col(f"m.{value}").alias("value"), F.col(f"m.{ts}").alias("ts"))


def metric_histogram(events: DataFrame, bounds: Sequence[float] = BUCKETS, name: str = "name",
                     value: str = "value") -> DataFrame:
    """Events per metric and bucket; ``le`` is the bucket's upper bound (infinity for the rest)."""
    bucket = F.lit(float("inf"))
    for b in sorted(bounds, reverse=True):
        bucket = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(bucket)
    return events.where(F.col(value).isNotNull()).groupBy(name, bucket.alias("le")).agg(F.count(F.lit(1)).alias("events"))


def metric_durations(events: DataFrame, status: str, name: str = "name", value: str = "value",
                     success: str = "success", p: float = 0.95) -> DataFrame:
    """Per operation: calls, mean, max and the exact ``p`` quantile of duration, share that succeeded."""
    stats = events.groupBy(name).agg(
        F.count(F.lit(1)).alias("calls"), F.avg(value).alias("mean"), F.max(value).alias("max"),
        (F.count_if(F.col(status) == success) / F.count(F.lit(1))).alias("success_ratio"))
    high = exact_quantiles(events, value, (p,), group=[name], names=("p",), few_groups=True).select(name, F.col("p").alias("p" + f"{p * 100:g}".replace(".", "_")))
    return join_same_key(stats, high, [name], "left")


def metric_summary(events: DataFrame, name: str = "name") -> DataFrame:
    """Events per metric."""
    return events.groupBy(name).agg(F.count(F.lit(1)).alias("events"))


def metric_retention(events: DataFrame, hours: int, as_of: str, ts: str = "ts") -> DataFrame:
    """Events newer than ``hours`` before ``as_of``."""
    cut = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(hours=F.lit(hours))
    return events.where(F.col(ts).cast("timestamp") > cut)


def retention_counts(events: DataFrame, hours: int, as_of: str, ts: str = "ts", name: str = "name") -> DataFrame:
    """Per metric: events kept and events cleared by ``metric_retention``."""
    cut = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(hours=F.lit(hours))
    kept = F.col(ts).cast("timestamp") > cut
    return events.groupBy(name).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("cleared"))


def metric_windows(events: DataFrame, width: str = "1 hour", watermark: str | None = None, name: str = "name",
                   value: str = "value", ts: str = "ts") -> DataFrame:
    """Tumbling-window count and sum per metric; works on a stream when ``watermark`` is given."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark(ts, watermark)
    return (timed.groupBy(F.window(ts, width).alias("w"), name)
            .agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), name, "events", "total"))
