"""Incremental ingest, quality checks and metric windows as ``availableNow`` streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.checks.raw import day_facts, merge_days, merge_values, validate_facts, value_facts
from tidemark.operators.checks.rows import DEFAULTS, CheckConfig
from tidemark.operators.metrics import metric_windows
from tidemark.sources.raw_store import upsert_raw


def file_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is declared, not inferred."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, state: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process everything that is there now in micro-batches, then stop."""
    query = (stream.writeStream.foreachBatch(each).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def without_repeats(stream: DataFrame, ts: str, delay: str = "7 days") -> DataFrame:
    """Drop rows that repeat another within ``delay`` of event time in all columns, ahead of the upsert.

    A row that differs in its payload or its time is a correction and goes on to the upsert.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark()


def stream_ingest(stream: DataFrame, normalise: Callable[[DataFrame], DataFrame], target: str, state: str,
                  grain: str = "month", items: Mapping[str, Sequence[str]] | None = None) -> None:
    """Upsert every micro-batch into the raw table; replaying a batch changes nothing.

    ``items`` tells several observations of a day apart (see ``upsert_raw``).
    """
    run_available(stream, state, lambda batch, _: upsert_raw(normalise(batch), target, grain, items))


def stream_quality(stream: DataFrame, normalise: Callable[[DataFrame], DataFrame], sources: Sequence[str], as_of: str,
                   stored: str, target: str, state: str, cfg: CheckConfig = DEFAULTS) -> None:
    """Keep the facts of every micro-batch, then check all of them together and replace the check rows at ``target``.

    Completeness, freshness, gaps, duplicates and outliers are facts of the whole table, so ``stored`` keeps, per batch, one row per
    (source, date) and one per (source, number) with their counts. These add up, so the checks equal those of all
    rows however files fall into batches, and a run reads its new files and the facts, never earlier rows. A replayed batch
    overwrites its own folder of ``stored``, and a run that finds nothing new checks again. ``stored``
    belongs to ``state``: begin both anew together.
    """
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch_id: int) -> None:
        for kind, facts in (("days", day_facts(rows)), ("values", value_facts(rows, sources))):
            facts.write.mode("overwrite").parquet(f"{stored}/{kind}/batch_id={batch_id}")

    # Without any batch there are still facts to check: none.
    keep(normalise(spark.createDataFrame([], stream.schema)), -1)
    run_available(stream, state, lambda batch, batch_id: keep(normalise(batch), batch_id))
    days, values = (spark.read.parquet(f"{stored}/{kind}").drop("batch_id") for kind in ("days", "values"))
    validate_facts(merge_days(days), merge_values(values), sources, as_of, cfg).write.mode("overwrite").parquet(target)


def stream_metric_windows(stream: DataFrame, target: str, state: str, width: str = "1 hour",
                          watermark: str = "2 hours", **names: str) -> None:
    """Append closed tumbling windows of a metric stream to Parquet."""
    query = (metric_windows(stream, width, watermark, **names).writeStream.format("parquet").outputMode("append")
             .option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
