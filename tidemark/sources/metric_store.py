"""Metric events as a table of days, with removal of old rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.workdir import stage


def write_metrics(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Append events to the table at ``path``, partitioned by the day of ``ts``; a row without time goes to a day of its own."""
    events.withColumn("day", F.to_date(ts)).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The events, with the declared schema; filters on ``day`` prune partitions."""
    return spark.read.schema(T.StructType([*schema, T.StructField("day", T.DateType())])).parquet(path)


def remove_old_metrics(spark: SparkSession, path: str, schema: T.StructType, hours: int, as_of: str, ts: str = "ts") -> int:
    """Remove the events at or before ``hours`` before ``as_of`` and return their number; rows without a time stay.

    Days that end before the cut are dropped as folders and counted without reading a column; only the
    day of the cut is read and written anew. Running it again removes nothing more.
    """
    cut = datetime.fromisoformat(as_of) - timedelta(hours=hours)
    table, at = read_metrics(spark, path, schema), F.lit(cut.isoformat(sep=" ")).cast(schema[ts].dataType)
    gone = table.where(F.col("day") < F.lit(cut.date()))
    removed = gone.count()
    days = [r["day"] for r in gone.select("day").distinct().collect()]
    edge = table.where(F.col("day") == F.lit(cut.date()))
    kept = stage(edge.where(F.col(ts) > at))
    n_edge, n_kept = edge.count(), kept.count()
    folder = lambda day: f"{path}/day={day.isoformat()}"
    if n_kept < n_edge:
        removed += n_edge - n_kept
        if n_kept:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        else:
            days.append(cut.date())
    for day in days:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder(day))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return removed
