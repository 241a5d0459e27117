"""Checks on the raw table. One scan gives the facts of every source; each check is a row of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import safe_div
from tidemark.operators.blocks import one_per_day, block_key, series_window
from tidemark.operators.joins import join_same_key
from tidemark.operators.checks.evidence import first_values, mark_days
from tidemark.operators.checks.evidence import listed as dates_listed
from tidemark.operators.checks.rows import DEFAULTS, CheckConfig, check, emit, emit_where, listed, union_checks
from tidemark.sources.raw_store import recent_rows


def _named(raw: DataFrame) -> DataFrame:
    return raw.withColumn("source", F.coalesce("source", F.lit("(none)")))


def day_facts(raw: DataFrame) -> DataFrame:
    """(source, date): rows, null payloads and latest ingest. Facts of parts of a table add up with ``merge_days``.

    The grouping combines before the shuffle, so a hot source never sends more than one row per day and task. A null
    source goes by the name "(none)". An ingest time kept as ISO text, with or without the ``Z`` suffix, is parsed;
    text that is no time counts as missing.
    """
    ingested = F.col("ingested_at")
    if isinstance(raw.schema["ingested_at"].dataType, T.StringType):
        ingested = F.try_to_timestamp(ingested)
    return _named(raw).groupBy("source", "date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("data").isNull()).alias("nulls"), F.max(ingested).alias("latest_ingest"))


def merge_days(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source", "date").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.max("latest_ingest").alias("latest_ingest"))


def source_facts(raw: DataFrame, sources: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Per source, declared or present: rows, nulls, latest date and ingest, duplicate keys, date gaps, and the first of both.

    Declared sources without any row are kept with zero counts, and sources that nobody
    declared are marked by ``declared``.
    """
    return facts_of_days(day_facts(raw), sources, cfg)


def facts_of_days(days: DataFrame, sources: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """``source_facts`` from one row per (source, date)."""
    spark = days.sparkSession
    days = one_per_day(days)
    days = mark_days(days, "date", cfg.evidence_dates, key=block_key(days, "source"))
    seen = days.groupBy("source").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.max("date").alias("latest_date"),
        F.max("latest_ingest").alias("latest_ingest"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.count_if(F.col("gap") > 1).alias("gaps"),
        dates_listed("__twice").alias("duplicate_dates"), dates_listed("__hole").alias("missing_dates"))
    return listed(spark, "source", sources).join(seen, "source", "full").select(
        "source", F.col("source").isin(*sources).alias("declared"), "latest_date", "latest_ingest", "duplicate_dates", "missing_dates",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n", "nulls", "duplicate_keys", "gaps")])


def _about(text: str) -> Column:
    return F.concat(F.lit(text), F.col("source"))


def _completeness(cfg: CheckConfig) -> Column:
    return check("data_completeness", F.col("n") >= cfg.min_records_per_source, severity="warning",
                 subject=F.col("source"), metric="record_count", value=F.col("n"),
                 threshold=cfg.min_records_per_source,
                 good=_about("enough records in "), bad=_about("too few records in "))


def _freshness(cfg: CheckConfig, as_of: str) -> Column:
    hours = (F.unix_micros(F.to_timestamp(F.lit(as_of))) -
             F.unix_micros(F.col("latest_ingest").cast("timestamp"))) / F.lit(3.6e9)
    return check("data_freshness", hours <= cfg.freshness_hours, severity="warning",
                 subject=F.col("source"), metric="hours_old", value=hours, threshold=cfg.freshness_hours,
                 good=_about("fresh data from "), bad=_about("stale data from "),
                 details={"latest_date": F.col("latest_date"), "latest_ingest": F.col("latest_ingest")})


def _duplicates() -> Column:
    return check("data_consistency", F.col("duplicate_keys") == 0, severity="warning",
                 subject=F.col("source"), metric="duplicate_keys", value=F.col("duplicate_keys"), threshold=0,
                 good=_about("no duplicate dates in "), bad=_about("duplicate dates in "),
                 details={"dates": F.col("duplicate_dates")})


def _continuity() -> Column:
    return check("data_continuity", F.col("gaps") == 0, severity="warning",
                 subject=F.col("source"), metric="date_gaps", value=F.col("gaps"), threshold=0,
                 good=_about("no date gaps in "), bad=_about("date gaps in "),
                 details={"missing": F.col("missing_dates")})


def _payload(cfg: CheckConfig) -> Column:
    ratio = safe_div("nulls", "n")
    worst = F.when(ratio < cfg.null_payload_error, "warning").otherwise("error")
    return check("data_quality", F.col("nulls") == 0, severity=worst, subject=F.col("source"),
                 metric="null_ratio", value=ratio, threshold=cfg.null_payload_error,
                 good=_about("no null data in "), bad=_about("null data in "))


def _declared() -> Column:
    return check("source_declared", F.col("declared"), severity="warning", subject=F.col("source"),
                 metric="record_count", value=F.col("n"), threshold=0,
                 good=_about("declared source "), bad=_about("undeclared source "))


def check_availability(df: DataFrame, subject: str = "raw_data") -> DataFrame:
    """Critical when the input has no rows."""
    facts = df.agg(F.count(F.lit(1)).alias("n"))
    return emit(facts, [check("data_availability", F.col("n") > 0, severity="critical", subject=subject,
                              metric="record_count", value=F.col("n"), threshold=1,
                              good="data available", bad="no data found")])


def check_completeness(raw: DataFrame, sources: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    return emit(source_facts(raw, sources), [_completeness(cfg)])


def check_freshness(raw: DataFrame, sources: Sequence[str], as_of: str, cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Latest ingest per source against ``as_of``; a source without rows is stale."""
    return emit(source_facts(raw, sources), [_freshness(cfg, as_of)])


def check_consistency(raw: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Duplicate dates, and date gaps for sources with more than one row."""
    return emit_where(source_facts(raw, sources),
                      [(F.col("n") > 0, _duplicates()), (F.col("n") > 1, _continuity())])


def check_null_payload(raw: DataFrame, sources: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    return emit_where(source_facts(raw, sources), [(F.col("n") > 0, _payload(cfg))])


def payload_numbers(raw: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(source, value): every top-level JSON number in the payloads, of undeclared sources as well.

    Texts that look like numbers, booleans and nested values do not count.
    """
    doc = _named(raw).select("source", F.try_parse_json("data").alias("doc"))
    fields = doc.lateralJoin(raw.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    kind = F.schema_of_variant("value")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    value = F.try_variant_get("value", "$", "double")
    return fields.where(number).select("source", value.alias("value")).where(F.col("value").isNotNull())


def value_facts(raw: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(source, value, n): how often each payload number occurs. Facts of parts of a table add up with ``merge_values``."""
    return payload_numbers(raw, sources).groupBy("source", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_values(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source", "value").agg(F.sum("n").alias("n"))


def outlier_facts(raw: DataFrame, sources: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Per source: numbers, z-score outliers (population deviation), values out of range, and the first different ones of both.

    Outliers are named from the one furthest from the mean, values out of range from the smallest.
    """
    numbers = payload_numbers(raw, sources)
    stats = numbers.groupBy("source").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return _outlier_counts(numbers.withColumn("n", F.lit(1).cast("bigint")), stats, cfg)


def outliers_of_values(values: DataFrame, cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """``outlier_facts`` from one row per (source, value)."""
    means = values.groupBy("source").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    apart = F.col("value") - F.col("mean")
    stats = join_same_key(values, means, ["source"]).groupBy("source").agg(
        F.first("mean").alias("mean"), F.sqrt(F.sum(apart * apart * F.col("n")) / F.sum("n")).alias("std"))
    return _outlier_counts(values, stats, cfg)


def _outlier_counts(numbers: DataFrame, stats: DataFrame, cfg: CheckConfig) -> DataFrame:
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for s, (a, b) in cfg.ranges.items():
        low = F.when(F.col("source") == s, F.lit(float(a))).otherwise(low)
        high = F.when(F.col("source") == s, F.lit(float(b))).otherwise(high)
    z = safe_div(F.col("value") - F.col("mean"), "std")
    marked = numbers.join(stats, "source").select(
        "source", "value", "n", F.abs(z).alias("far"), F.coalesce(F.abs(z) > cfg.z_limit, F.lit(False)).alias("is_outlier"),
        F.coalesce((F.col("value") < low) | (F.col("value") > high), F.lit(False)).alias("is_out"), low.isNotNull().alias("has_range"))
    # One row per value that is named by a check, and one per source for all others.
    named = F.col("is_outlier") | F.col("is_out")
    folded = marked.groupBy("source", F.when(named, F.col("value")).alias("value"), "is_outlier", "is_out").agg(
        F.sum("n").alias("n"), F.max("far").alias("far"), F.bool_or("has_range").alias("has_range"))
    some = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0).cast("bigint"))
    counts = folded.groupBy("source").agg(
        F.sum("n").alias("n"), some("is_outlier").alias("outliers"), some("is_out").alias("out_of_range"),
        F.bool_or("has_range").alias("has_range"), F.max("far").alias("max_abs_z"))
    values = first_values(folded, [("outlier_values", F.col("is_outlier"), -F.col("far"), cfg.evidence_outliers),
                                   ("range_values", F.col("is_out"), F.lit(0), cfg.evidence_ranges)])
    return counts.join(values, "source", "left")


def _outliers(cfg: CheckConfig) -> Column:
    return check("outlier_detection", F.col("outliers") == 0, severity="warning", subject=F.col("source"),
                 metric="outlier_count", value=F.col("outliers"), threshold=cfg.z_limit,
                 good=_about("no outliers in "), bad=_about("outliers in "),
                 details={"values": F.col("outlier_values")})


def _ranges() -> Column:
    return check("range_validation", F.col("out_of_range") == 0, severity="error", subject=F.col("source"),
                 metric="out_of_range_count", value=F.col("out_of_range"), threshold=0,
                 good=_about("all values in range in "), bad=_about("values out of range in "),
                 details={"values": F.col("range_values")})


def check_raw_outliers(raw: DataFrame, sources: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    return emit(outlier_facts(raw, sources, cfg), [_outliers(cfg)])


def check_ranges(raw: DataFrame, sources: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    return emit_where(outlier_facts(raw, sources, cfg), [(F.col("has_range"), _ranges())])


def outlier_values(raw: DataFrame, sources: Sequence[str], k: int = 10, cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """The ``k`` z-score outliers of each source furthest from its mean, for the report."""
    numbers = payload_numbers(raw, sources)
    stats = numbers.groupBy("source").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    z = safe_div(F.col("value") - F.col("mean"), "std")
    w = Window.partitionBy("source").orderBy(F.desc(F.abs("z")), F.asc("value"))
    far = numbers.join(stats, "source").withColumn("z", z).where(F.abs("z") > cfg.z_limit)
    return far.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "source", "rank", "value", "z")


def validate_raw(raw: DataFrame, sources: Sequence[str], as_of: str, cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """All raw checks: one pass for the source facts, two for the payload numbers.

    Sources outside the declared list are checked like the others and get a warning of their own.
    """
    return _all_checks(source_facts(raw, sources, cfg), outlier_facts(raw, sources, cfg), sources, as_of, cfg)


def validate_facts(days: DataFrame, values: DataFrame, sources: Sequence[str], as_of: str, cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """``validate_raw`` of a table of which only its facts per (source, date) and per (source, value) are kept."""
    return _all_checks(facts_of_days(days, sources, cfg), outliers_of_values(values, cfg), sources, as_of, cfg)


def _all_checks(facts: DataFrame, numbers: DataFrame, sources: Sequence[str], as_of: str, cfg: CheckConfig) -> DataFrame:
    # One row per source, so the unpartitioned total is over a handful of rows.
    facts = facts.withColumn("total", F.sum("n").over(Window.partitionBy()))
    seen = F.col("n") > 0
    per_source = emit_where(facts, [
        (F.col("source") == sources[0], check(
            "data_availability", F.col("total") > 0, severity="critical", subject="raw_data", metric="record_count",
            value=F.col("total"), threshold=1, good="data available", bad="no data found")),
        (F.lit(True), _completeness(cfg)), (F.lit(True), _freshness(cfg, as_of)), (seen, _duplicates()),
        (F.col("n") > 1, _continuity()), (seen, _payload(cfg)), (~F.col("declared"), _declared())])
    return union_checks([per_source, emit_where(numbers, [(F.lit(True), _outliers(cfg)), (F.col("has_range"), _ranges())])])


# --- quality of the rows ingested lately -------------------------------------------------

def recent_facts(raw: DataFrame, sources: Sequence[str], as_of: str, rate_field: str, price_field: str,
                 rate_sources: Sequence[str], price_sources: Sequence[str],
                 cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Per source over the rows of the last ``cfg.recent_days`` days: missing required fields, rate spikes, negative prices.

    With ``cfg.recent_rows`` a source is judged by that many of its newest rows instead of all. Sources that nobody
    declared have rows of their own, without required fields.
    """
    recent = recent_rows(_named(raw), as_of, cfg.recent_days, cfg.recent_rows)
    doc = F.from_json("data", "map<string,string>")
    required = F.lit(None).cast("array<string>")
    for s, fields in cfg.required.items():
        required = F.when(F.col("source") == s, F.array(*[F.lit(f) for f in fields])).otherwise(required)
    rows = recent.select("source", doc.alias("doc"), F.coalesce(required, F.array().cast("array<string>")).alias("need"))
    rate = F.when(F.col("source").isin(*rate_sources),
                  F.nullif(F.try_element_at("doc", F.lit(rate_field)).try_cast("double"), F.lit(0.0)))
    price = F.when(F.col("source").isin(*price_sources),
                   F.try_element_at("doc", F.lit(price_field)).try_cast("double"))
    rows = rows.select("source", F.filter("need", lambda f: F.try_element_at(F.col("doc"), f).isNull()).alias("missing"),
                       rate.alias("rate"), price.alias("price"))
    means = rows.where(F.col("rate").isNotNull()).groupBy("source").agg(F.avg("rate").alias("mean"))
    far = safe_div(F.abs(F.col("rate") - F.col("mean")), "mean") > cfg.rate_spike
    rows = rows.join(means, "source", "left").select(*rows.columns, far.alias("spike"))
    seen = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing")))).alias("missing"),
        F.coalesce(F.bool_or("spike"), F.lit(False)).alias("rate_spike"),
        F.coalesce(F.bool_or(F.col("price") < 0), F.lit(False)).alias("negative_price"))
    return listed(raw.sparkSession, "source", sources).join(seen, "source", "full").select(
        "source", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        F.coalesce("missing", F.array().cast("array<string>")).alias("missing"),
        F.coalesce("rate_spike", F.lit(False)).alias("rate_spike"),
        F.coalesce("negative_price", F.lit(False)).alias("negative_price"))


def required_field_checks(facts: DataFrame) -> DataFrame:
    missing = F.array_join("missing", ",")
    return emit_where(facts, [(F.col("n") > 0, check(
        "required_fields", F.size("missing") == 0, severity="error", subject=F.col("source"),
        metric="missing_fields", value=F.size("missing"), threshold=0, good="all required fields present",
        bad=F.concat(F.lit("missing fields: "), missing), details={"fields": missing}))])


def ingest_quality(facts: DataFrame) -> DataFrame:
    """Per source: the three check outcomes and the overall pass, warning or fail."""
    some = F.col("n") > 0
    availability = F.when(some, "pass").otherwise("fail")
    completeness = F.when(some, F.when(F.size("missing") == 0, "pass").otherwise("fail"))
    consistency = F.when(some, F.when(F.col("rate_spike") | F.col("negative_price"), "warning").otherwise("pass"))
    overall = (F.when(~some | (F.size("missing") > 0), "fail")
                .when(F.col("rate_spike") | F.col("negative_price"), "warning").otherwise("pass"))
    return facts.select("source", "n", availability.alias("data_availability"), completeness.alias("completeness"),
                        consistency.alias("consistency"), overall.alias("overall_status"))


def rate_spikes(df: DataFrame, value: str, *, key: Sequence[str], limit: float = 0.1) -> DataFrame:
    """Per key: mean, rows further than ``limit`` of the mean from it, and whether there is any."""
    stats = df.groupBy(*key).agg(F.avg(value).alias("mean"))
    far = safe_div(F.abs(F.col(value) - F.col("mean")), F.col("mean")) > limit
    return join_same_key(df.select(*key, value), stats, list(key)).groupBy(*key, "mean").agg(
        F.count_if(far).alias("deviating_rows"), F.coalesce(F.bool_or(far), F.lit(False)).alias("has_spike"))


def source_health(raw: DataFrame, sources: Sequence[str], as_of: str, cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Last ingest, rows and ``ok``, ``degraded`` or ``error`` per source, by freshness."""
    facts = source_facts(raw, sources)
    hours = (F.unix_micros(F.to_timestamp(F.lit(as_of))) -
             F.unix_micros(F.col("latest_ingest").cast("timestamp"))) / F.lit(3.6e9)
    return facts.select("source", F.col("latest_ingest").alias("last_ingestion"), F.col("n").alias("records"),
                        F.when(F.col("n") == 0, "error").when(hours > cfg.freshness_hours, "degraded")
                        .otherwise("ok").alias("health"))
