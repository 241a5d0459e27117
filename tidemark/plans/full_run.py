"""Ingest, validate, build features, validate, store, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import numeric_columns
from tidemark.operators.checks.features import validate_features
from tidemark.operators.checks.raw import validate_raw
from tidemark.operators.checks.rows import DEFAULTS, CheckConfig, report, union_checks
from tidemark.plans.features import FeatureSpec, create_features
from tidemark.sources.feature_store import pack_features, write_features, write_report
from tidemark.sources.raw_store import read_raw, upsert_raw


def stage_report(raw_checks: DataFrame, feature_checks: DataFrame) -> DataFrame:
    """One report row per stage and one overall row whose score is the mean of the two."""
    checks = union_checks([raw_checks]).withColumn("stage", F.lit("raw")).unionByName(
        union_checks([feature_checks]).withColumn("stage", F.lit("features")))
    per = report(checks, by=["stage"])
    worst = F.max(F.when(F.col("critical") > 0, 3).when(F.col("error") > 0, 2).when(F.col("warning") > 0, 1).otherwise(0))
    names = F.array(*[F.lit(s) for s in ("PASSED", "WARNING", "ERROR", "CRITICAL")])
    counts = ("total_checks", "passed_checks", "failed_checks", "info", "warning", "error", "critical")
    overall = per.agg(*[F.sum(c).alias(c) for c in counts], F.avg("quality_score").alias("quality_score"),
                      worst.alias("w")).select(
        F.lit("overall").alias("stage"), *counts, "quality_score", names[F.col("w")].alias("overall_status"))
    return per.unionByName(overall)


def full_run(spark: SparkSession, new_rows: DataFrame, work: str, sources: Sequence[str], spec: FeatureSpec, *,
             start: str, end: str, as_of: str, check_cols: Sequence[str] | None = None,
             grain: str = "month", cfg: CheckConfig = DEFAULTS, items: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Run every stage under the folder ``work`` and return the report.

    Each stage reads what the stage before wrote, so a lost executor costs at most one
    stage, and the wide feature frame is computed once for validation and storage. ``items`` tells several
    observations of a day apart (see ``upsert_raw``).
    """
    upsert_raw(new_rows, f"{work}/raw", grain, items)
    raw = read_raw(spark, f"{work}/raw")
    window = read_raw(spark, f"{work}/raw", start, end, grain)
    create_features(window, spec, start, end).write.mode("overwrite").parquet(f"{work}/frame")
    frame = spark.read.parquet(f"{work}/frame")
    numbers = numeric_columns(frame, exclude=(*spec.key, spec.order))
    write_features(pack_features(frame, numbers), f"{work}/features", mode="overwrite")
    checks = validate_features(frame, list(check_cols) if check_cols is not None else None, cfg,
                               key=list(spec.key), order=spec.order)
    out = stage_report(validate_raw(raw, sources, as_of, cfg), checks)
    write_report(out, f"{work}/report")
    return spark.read.schema(out.schema).json(f"{work}/report")
