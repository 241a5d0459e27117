"""Check rows: one long table for every check (see ``tidemark.schemas.CHECK``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import CHECK
from tidemark.sources.registry import EXPECTED_RANGES, REQUIRED_FIELDS


@dataclass(frozen=True)
class CheckConfig:
    """Thresholds of all checks; the defaults are fixed values."""

    min_records_per_source: int = 10
    freshness_hours: float = 48.0
    z_limit: float = 3.0
    null_payload_error: float = 0.1
    missing_ratio: float = 0.1
    skew_limit: float = 2.0
    min_for_distribution: int = 10
    corr_limit: float = 0.95
    max_change: float = 0.5
    iqr_pass_ratio: float = 0.05
    min_rows: int = 10
    min_features: int = 10
    rate_min: float = 100.0
    rate_max: float = 2000.0
    rate_max_daily_pct: float = 20.0
    rate_max_spread_pct: float = 100.0
    stale_days: int = 7
    outlier_pct: float = 5.0
    null_pct: tuple[float, float] = (10.0, 20.0)
    duplicate_pct: tuple[float, float] = (5.0, 10.0)
    iqr_pct: tuple[float, float] = (5.0, 10.0)
    extreme_z: float = 5.0
    min_completeness: float = 0.8
    fx_range: tuple[float, float] = (0.0, 10000.0)
    fx_mean: tuple[float, float] = (100.0, 5000.0)
    fx_volatility: float = 0.5
    rate_spike: float = 0.1
    recent_days: int = 7
    recent_rows: int | None = None  # judge a source by this many of its newest rows; all by default
    # How many outliers, values out of range and dates a check row names.
    evidence_outliers: int = 10
    evidence_ranges: int = 5
    evidence_dates: int = 10
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=lambda: dict(EXPECTED_RANGES))
    required: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(REQUIRED_FIELDS))


DEFAULTS = CheckConfig()


def _as(c, kind: str) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast(kind)


def check(name: str, passed: Column, *, severity: str | Column, subject: Column | str | None, metric: str,
          value: Column | None, threshold=None, good: str | Column = "ok", bad: str | Column = "failed",
          details: Mapping[str, Column] | None = None, severity_if_passed: str = "info") -> Column:
    """One check result as a struct column; ``severity`` applies when it does not pass."""
    ok = F.coalesce(passed, F.lit(False))
    info = F.create_map(*[x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]) \
        if details else F.create_map()
    return F.struct(
        F.lit(name).alias("check_name"),
        F.when(ok, F.lit(severity_if_passed)).otherwise(_as(severity, "string")).alias("severity"),
        _as(subject, "string").alias("subject"),
        F.lit(metric).alias("metric"),
        _as(value, "double").alias("value"),
        _as(threshold, "double").alias("threshold"),
        ok.alias("passed"),
        F.when(ok, _as(good, "string")).otherwise(_as(bad, "string")).alias("message"),
        info.cast("map<string,string>").alias("details"))


def emit(facts: DataFrame, checks: Sequence[Column]) -> DataFrame:
    """Turn each fact row into one row per check, in one pass."""
    return facts.select(F.explode(F.array(*checks)).alias("r")).select("r.*")


def emit_where(facts: DataFrame, checks: Sequence[tuple[Column, Column]]) -> DataFrame:
    """As ``emit``, where each check applies only if its condition holds."""
    rows = F.array(*[F.when(F.coalesce(cond, F.lit(False)), c) for cond, c in checks])
    return facts.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def one_row(spark: SparkSession) -> DataFrame:
    """A frame with a single row, to hang literals on."""
    return spark.range(0, 1, 1, 1)


def listed(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """A declared list as a one-column frame."""
    return one_row(spark).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def driver_checks(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Check rows known from the schema alone: (name, severity, subject, metric, value, threshold, passed, message)."""
    names = CHECK.fieldNames()
    structs = [F.struct(*[F.lit(v).cast(CHECK[n].dataType).alias(n) for n, v in zip(names, r)],
                        F.create_map().cast("map<string,string>").alias("details")) for r in rows]
    return emit(one_row(spark), structs)


def union_checks(parts: Sequence[DataFrame]) -> DataFrame:
    """All check rows of several checks, in the common schema."""
    out = parts[0].select(*CHECK.fieldNames())
    for p in parts[1:]:
        out = out.unionByName(p.select(*CHECK.fieldNames()))
    return out


def report(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by severity, passed and failed, quality score, and the worst severity as status."""
    def of(s: str) -> Column:
        return F.count_if(F.col("severity") == s)

    per = checks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(F.col("passed")).alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        of("info").alias("info"), of("warning").alias("warning"),
        of("error").alias("error"), of("critical").alias("critical"))
    return per.withColumns({
        "quality_score": F.coalesce(F.col("passed_checks") / F.nullif(F.col("total_checks"), F.lit(0)), F.lit(0.0)),
        "overall_status": F.when(F.col("critical") > 0, "CRITICAL").when(F.col("error") > 0, "ERROR")
                           .when(F.col("warning") > 0, "WARNING").otherwise("PASSED"),
    })


def score_validation(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``1 - 0.2 * errors - 0.1 * warnings`` of the failed checks, clamped to [0, 1]."""
    failed = ~F.col("passed")
    per = checks.groupBy(*by).agg(
        F.count_if(failed & F.col("severity").isin("error", "critical")).alias("errors"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"))
    raw = 1 - 0.2 * F.col("errors") - 0.1 * F.col("warnings")
    return per.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)),
                            "is_valid": F.col("errors") == 0})
