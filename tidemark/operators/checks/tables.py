"""Rule sets on whole tables: structure, rates, time series, numbers, categories, schema, quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import columns_named, numeric_columns
from tidemark.functions.numeric import is_infinite, nan_to_null, safe_div
from tidemark.operators.checks.evidence import listed, mark_days
from tidemark.operators.checks.features import check_features, zscore_facts
from tidemark.operators.checks.rows import (DEFAULTS, CheckConfig, check, driver_checks, emit, emit_where,
                                            union_checks)
from tidemark.operators.joins import join_same_key
from tidemark.operators.profile import (category_profile, completeness_score, constant_columns, duplicate_rows,
                                        iqr_outliers, numeric_profile, per_column)
from tidemark.operators.windows import change_from_last_valid, out_of_order_rows


def _column() -> Column:
    return F.col("column")


def check_min_rows(df: DataFrame, cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Not empty, and at least the minimum number of rows."""
    facts = df.agg(F.count(F.lit(1)).alias("n"))
    return emit(facts, [
        check("not_empty", F.col("n") > 0, severity="error", subject="table", metric="rows", value=F.col("n"),
              threshold=1, bad="data is empty"),
        check("min_rows", F.col("n") >= cfg.min_rows, severity="error", subject="table", metric="rows",
              value=F.col("n"), threshold=cfg.min_rows, bad="too few rows")])


def check_columns(df: DataFrame) -> DataFrame:
    """Duplicate names, all-null columns, constant number columns."""
    dup = len(df.columns) - len(set(df.columns))
    names = driver_checks(df.sparkSession, [(
        "duplicate_columns", "error" if dup else "info", "table", "duplicates", float(dup), 0.0, not dup,
        "duplicate column names" if dup else "ok")])
    if dup:
        return names
    numbers = numeric_columns(df)
    facts = per_column(df, df.columns, {
        "rows": lambda c: F.count(F.lit(1)),
        "nulls": lambda c: F.count_if(F.col(c).isNull())})
    empty = emit_where(facts, [(F.col("rows") > 0, check(
        "all_null_column", F.col("nulls") < F.col("rows"), severity="error", subject=_column(), metric="nulls",
        value=F.col("nulls"), threshold=None, bad="only null values"))])
    parts = [names, empty]
    if numbers:
        parts.append(emit_where(constant_columns(df, numbers), [(F.col("rows") > 0, check(
            "constant_column", ~F.col("is_constant"), severity="error", subject=_column(), metric="is_constant",
            value=F.col("is_constant").cast("int"), threshold=0, bad="constant values"))]))
    return union_checks(parts)


def check_rates(df: DataFrame, cols: Sequence[str] | None = None, cfg: CheckConfig = DEFAULTS, *,
                key, order) -> DataFrame:
    """Rate columns: negative, below and above limits, daily change, official to parallel spread."""
    cols = list(cols) if cols is not None else columns_named(df, ("rate",), floats_only=False)
    if not cols:
        return driver_checks(df.sparkSession, [("rate_columns", "error", "table", "columns", 0.0, 1.0, False,
                                                "no rate columns")])
    official = next((c for c in cols if "official" in c), None)
    parallel = next((c for c in cols if "parallel" in c), None)
    chg = change_from_last_valid(df, cols, key=key, order=order)

    def spread(c: str) -> Column:
        if c != official or parallel is None:
            return F.lit(None).cast("double")
        return F.max(F.abs(safe_div(F.col(parallel) - F.col(c), F.col(c)) * 100))

    facts = per_column(chg, cols, {
        "lo": lambda c: F.min(nan_to_null(F.col(c).cast("double"))),
        "hi": lambda c: F.max(nan_to_null(F.col(c).cast("double"))),
        "move": lambda c: F.max(F.abs(f"{c}_chg") * 100),
        "spread": spread})

    def rule(name: str, bad: Column, value: Column, limit: float) -> Column:
        return check(name, ~F.coalesce(bad, F.lit(False)), severity="error", subject=_column(), metric=name, value=value,
                     threshold=limit, good="ok", bad=name.replace("_", " ") + " outside limits")

    lo, hi, move = F.col("lo"), F.col("hi"), F.col("move")
    return emit_where(facts, [
        (F.lit(True), rule("negative_rate", lo < 0, lo, 0.0)),
        (F.lit(True), rule("minimum_rate", lo < cfg.rate_min, lo, cfg.rate_min)),
        (F.lit(True), rule("maximum_rate", hi > cfg.rate_max, hi, cfg.rate_max)),
        (F.lit(True), rule("daily_change", move > cfg.rate_max_daily_pct, move, cfg.rate_max_daily_pct)),
        (F.col("spread").isNotNull(), rule("rate_spread", F.col("spread") > cfg.rate_max_spread_pct,
                                           F.col("spread"), cfg.rate_max_spread_pct))])


def series_facts(df: DataFrame, date: str, as_of: str, cfg: CheckConfig = DEFAULTS, *, key: Sequence[str]) -> DataFrame:
    """Per series: rows, nulls, distinct and future dates, first and last date, and the first repeated and missing dates.

    Rows combine to one per (series, date) first, so no series is held by a distinct count.
    """
    end = F.to_date(F.lit(as_of))
    days = df.select(*key, F.col(date).cast("date").alias("d")).groupBy(*key, "d").agg(F.count(F.lit(1)).alias("n"))
    return mark_days(days, "d", cfg.evidence_dates, key=key).groupBy(*key).agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("n"))), F.lit(0)).alias("null_dates"),
        F.count("d").alias("dates"), F.coalesce(F.sum(F.when(F.col("d") > end, F.col("n"))), F.lit(0)).alias("future"),
        F.min("d").alias("first"), F.max("d").alias("last"), F.datediff(end, F.max("d")).alias("days_old"),
        listed("__twice").alias("duplicates"), listed("__hole").alias("missing"))


def _subject(key: Sequence[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in key]) if key else F.lit("series")


def check_time_series(df: DataFrame, date: str, as_of: str, cfg: CheckConfig = DEFAULTS, *, key: Sequence[str] = (),
                      seq: str | None = None) -> DataFrame:
    """Per series: unique dates, stored order (by ``seq``), missing, future and stale dates."""
    key = list(key)
    if date not in df.columns:
        return driver_checks(df.sparkSession, [("date_column", "error", date, "present", 0.0, 1.0, False,
                                                "no date column")])
    facts = series_facts(df, date, as_of, cfg, key=key)
    subject = _subject(key)
    spans = F.datediff("last", "first") + 1 - F.col("dates")
    checks = [
        check("unique_dates", F.col("rows") - F.col("null_dates") == F.col("dates"), severity="error", subject=subject,
              metric="duplicate_dates", value=F.col("rows") - F.col("null_dates") - F.col("dates"), threshold=0,
              bad="duplicate dates", details={"dates": F.col("duplicates")}),
        check("missing_dates", F.coalesce(spans, F.lit(0)) == 0, severity="error", subject=subject,
              metric="missing_dates", value=F.coalesce(spans, F.lit(0)), threshold=0, bad="missing dates",
              details={"missing": F.col("missing")}),
        check("future_dates", F.col("future") == 0, severity="error", subject=subject, metric="future_dates",
              value=F.col("future"), threshold=0, bad="future dates"),
        check("stale_data", F.col("days_old") <= cfg.stale_days, severity="error", subject=subject, metric="days_old",
              value=F.col("days_old"), threshold=cfg.stale_days, bad="data is stale")]
    parts = [emit(facts, checks)]
    if seq is not None:
        late = out_of_order_rows(df.select(*key, date, seq), date, key=key, seq=seq).groupBy(*key).agg(
            F.count(F.lit(1)).alias("late"))
        base = facts.select(*key, "rows")
        both = join_same_key(base, late, key, "left")
        parts.append(emit(both, [check(
            "sorted_dates", F.coalesce("late", F.lit(0)) == 0, severity="error", subject=subject,
            metric="out_of_order", value=F.coalesce("late", F.lit(0)), threshold=0, bad="dates not in order")]))
    return union_checks(parts)


def check_series_v2(df: DataFrame, date: str, as_of: str, cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Whole-table date rules: type, nulls, staleness; duplicate dates only warn."""
    if date not in df.columns:
        return driver_checks(df.sparkSession, [("date_column", "error", date, "present", 0.0, 1.0, False,
                                                "date column not found")])
    kind = df.schema[date].dataType
    ok = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    typed = driver_checks(df.sparkSession, [("date_type", "info" if ok else "error", date, "is_date", float(ok), 1.0, ok,
                                             "ok" if ok else f"invalid type {kind.simpleString()}")])
    if not ok:
        return typed
    facts = series_facts(df, date, as_of, cfg, key=[])
    dup = F.col("rows") - F.col("dates") - (F.col("null_dates") > 0).cast("int")
    return union_checks([typed, emit(facts, [
        check("null_dates", F.col("null_dates") == 0, severity="error", subject=date, metric="null_dates",
              value=F.col("null_dates"), threshold=0, bad="null dates"),
        check("date_range", F.lit(True), severity="info", subject=date, metric="range_days",
              value=F.datediff("last", "first"), details={"first": F.col("first"), "last": F.col("last")}),
        check("staleness", ~F.coalesce(F.col("days_old") > cfg.stale_days, F.lit(False)), severity="error", subject=date,
              metric="days_old", value=F.col("days_old"), threshold=cfg.stale_days, bad="data is stale"),
        check("duplicate_dates", dup == 0, severity="warning", subject=date, metric="duplicate_dates", value=dup,
              threshold=0, bad="duplicate dates", details={"dates": F.col("duplicates")})])])


def _two_step(name: str, value: Column, limits: tuple[float, float], subject, metric: str) -> Column:
    """Warning above the first limit, error above the second."""
    warn, error = limits
    return check(name, ~F.coalesce(value > warn, F.lit(False)), severity=F.when(value > error, "error").otherwise("warning"),
                 subject=subject, metric=metric, value=value, threshold=warn, bad=f"high {metric.replace('_', ' ')}")


def check_table(df: DataFrame, cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Null share and duplicate share of the whole table."""
    cells = completeness_score(df).select("rows", ((1 - F.col("completeness")) * 100).alias("null_pct"))
    dups = duplicate_rows(df).select(safe_div(F.col("duplicate_rows") * 100, "total_rows").alias("dup_pct"))
    return union_checks([
        emit(cells, [check("table_rows", F.col("rows") > 0, severity="error", subject="table", metric="rows",
                           value=F.col("rows"), threshold=1, bad="table is empty"),
                     _two_step("table_nulls", F.col("null_pct"), cfg.null_pct, "table", "null_pct")]),
        emit(dups, [_two_step("table_duplicates", F.col("dup_pct"), cfg.duplicate_pct, "table", "duplicate_pct")])])


def check_numeric(df: DataFrame, cols: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Per column: present and numeric, not all null, IQR share, infinities, extreme z-scores."""
    have = set(df.columns)
    numbers = [c for c in cols if c in have and isinstance(df.schema[c].dataType, T.NumericType)]
    parts = []
    wrong = [c for c in cols if c not in numbers]
    if wrong:
        parts.append(driver_checks(df.sparkSession, [
            ("numeric_type", "error", c, "is_numeric", 0.0, 1.0, False,
             "not numeric" if c in have else "column not found") for c in wrong]))
    if numbers:
        facts = per_column(df, numbers, {"n": lambda c: F.count(c),
                                         "infinite": lambda c: F.count_if(is_infinite(F.col(c).cast("double")))})
        parts.append(emit_where(facts, [
            (F.lit(True), check("all_null", F.col("n") > 0, severity="error", subject=_column(), metric="valid_count",
                                value=F.col("n"), threshold=1, bad="only null values")),
            (F.col("n") > 0, check("infinite_values", F.col("infinite") == 0, severity="error", subject=_column(),
                                   metric="infinite_count", value=F.col("infinite"), threshold=0,
                                   bad="infinite values"))]))
        pct = safe_div(F.col("outliers") * 100, "n")
        parts.append(emit(iqr_outliers(df, numbers), [_two_step("iqr_share", pct, cfg.iqr_pct, _column(), "outlier_pct")]))
        parts.append(emit(zscore_facts(df, numbers, cfg.extreme_z), [check(
            "extreme_values", F.col("outliers") == 0, severity="warning", subject=_column(), metric="extreme_count",
            value=F.col("outliers"), threshold=cfg.extreme_z, bad="extreme values")]))
    return union_checks(parts)


def check_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: distinct values above half the rows; most frequent over ten times the least."""
    have = set(df.columns)
    known = [c for c in cols if c in have]
    parts = [driver_checks(df.sparkSession, [
        ("category_column", "error", c, "present", 0.0, 1.0, False, "column not found")
        for c in cols if c not in have])] if len(known) < len(cols) else []
    if known:
        parts.append(emit_where(category_profile(df, known), [
            (F.lit(True), check("cardinality", ~F.col("high_cardinality"), severity="warning", subject=_column(),
                                metric="unique_ratio", value=safe_div("unique_values", "rows"), threshold=0.5,
                                bad="many distinct values")),
            (F.col("unique_values") > 1, check("imbalance", ~F.col("imbalanced"), severity="warning", subject=_column(),
                                               metric="max_to_min", value=safe_div("max_count", "min_count"),
                                               threshold=10, bad="imbalanced categories"))]))
    return union_checks(parts)


def check_schema(df: DataFrame, required: Sequence[str] = (), types: Mapping[str, T.DataType] | None = None,
                 limits: Mapping[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Required columns, column types, and minimum and maximum values (one aggregate)."""
    have = {f.name: f.dataType for f in df.schema}
    rows = [("required_column", "info" if c in have else "error", c, "present", float(c in have), 1.0, c in have,
             "ok" if c in have else "required column missing") for c in required]
    for c, want in (types or {}).items():
        if c in have:
            ok = have[c] == want
            rows.append(("column_type", "info" if ok else "error", c, "type_matches", float(ok), 1.0, ok,
                         "ok" if ok else f"expected {want.simpleString()}"))
    parts = [driver_checks(df.sparkSession, rows)] if rows else []
    bounded = {c: b for c, b in (limits or {}).items() if c in have}
    if bounded:
        facts = per_column(df, list(bounded), {"lo": lambda c: F.min(nan_to_null(F.col(c).cast("double"))),
                                               "hi": lambda c: F.max(nan_to_null(F.col(c).cast("double")))})
        checks = []
        for c, (lo, hi) in bounded.items():
            for name, bound, seen, bad in (("min_value", lo, F.col("lo"), F.col("lo") < F.lit(lo)),
                                           ("max_value", hi, F.col("hi"), F.col("hi") > F.lit(hi))):
                if bound is not None:
                    checks.append((_column() == c, check(name, ~F.coalesce(bad, F.lit(False)), severity="error", subject=_column(),
                                                    metric=name, value=seen, threshold=bound, bad="value outside limit")))
        parts.append(emit_where(facts, checks))
    return union_checks(parts)


def check_negative_price(df: DataFrame, col: str = "price") -> DataFrame:
    """Negative values in a price column only warn."""
    facts = df.agg(F.min(nan_to_null(F.col(col).cast("double"))).alias("lo"))
    return emit(facts, [check("negative_price", ~F.coalesce(F.col("lo") < 0, F.lit(False)), severity="warning",
                              subject=col, metric="min", value=F.col("lo"), threshold=0, bad="negative prices")])


def check_fx(df: DataFrame, col: str, date: str = "date", cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Schema of a rate table, then mean outside the normal band and volatility above half the mean."""
    schema = check_schema(df, required=(date, col), types={date: T.DateType(), col: T.DoubleType()},
                          limits={col: cfg.fx_range})
    lo, hi = cfg.fx_mean
    mean, std = F.col("mean"), F.col("std")
    return union_checks([schema, emit_where(numeric_profile(df, [col]), [
        (F.col("count") > 0, check("fx_mean", mean.between(lo, hi), severity="warning", subject=_column(), metric="mean",
                                   value=mean, threshold=hi, bad="mean outside normal band")),
        (F.col("count") > 0, check("fx_volatility", ~F.coalesce(std > mean * cfg.fx_volatility, F.lit(False)),
                                   severity="warning", subject=_column(), metric="std", value=std,
                                   threshold=mean * cfg.fx_volatility, bad="high volatility"))])])


def quality_checks(df: DataFrame, as_of: str, cfg: CheckConfig = DEFAULTS, date: str = "date",
                   price: str = "price") -> DataFrame:
    """Table rules, completeness, negative prices and date rules together."""
    done = emit(completeness_score(df), [check(
        "completeness", F.col("completeness") >= cfg.min_completeness, severity="error", subject="table",
        metric="completeness", value=F.col("completeness"), threshold=cfg.min_completeness, bad="too many nulls")])
    parts = [check_table(df, cfg), done]
    if price in df.columns:
        parts.append(check_negative_price(df, price))
    if date in df.columns:
        parts.append(check_series_v2(df, date, as_of, cfg))
    return union_checks(parts)


def score_quality(df: DataFrame, as_of: str, cfg: CheckConfig = DEFAULTS, date: str = "date",
                  price: str = "price") -> DataFrame:
    """``0.4 * completeness + 0.6 * validation score``, with both parts."""
    checks = quality_checks(df, as_of, cfg, date, price)
    completeness = F.max(F.when(F.col("check_name") == "completeness", F.col("value"))).alias("completeness")
    rows = F.max(F.when(F.col("check_name") == "table_rows", F.col("value"))).alias("rows")
    failed = ~F.col("passed")
    one = checks.agg(completeness, rows, F.count_if(failed & (F.col("severity") == "error")).alias("errors"),
                     F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.2 * F.col("errors") - 0.1 * F.col("warnings")))
    return one.select("completeness", "errors", "warnings", score.alias("validation_score"),
                      F.when(F.col("rows") == 0, 0.0).otherwise(0.4 * F.col("completeness") + 0.6 * score)
                      .alias("quality_score"))


def validate(df: DataFrame, kind: str = "general", cfg: CheckConfig = DEFAULTS, *, as_of: str | None = None,
             key: Sequence[str] = (), order: str = "date", seq: str | None = None) -> DataFrame:
    """General checks plus one of ``rates``, ``time_series`` or ``features``."""
    parts = [check_min_rows(df, cfg)]
    if kind == "rates":
        parts.append(check_rates(df, cfg=cfg, key=list(key), order=order))
    elif kind == "time_series":
        if as_of is None:
            raise ValueError("time_series needs as_of")
        parts.append(check_time_series(df, order, as_of, cfg, key=key, seq=seq))
    elif kind == "features":
        parts.append(check_features(df, cfg, exclude=(*key, order)))
    elif kind != "general":
        raise ValueError(f"unknown kind {kind!r}")
    parts.append(check_columns(df))
    return union_checks(parts)

