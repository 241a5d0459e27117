"""Checks on a feature frame: nulls, distribution, correlation, stability, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import numeric_columns
from tidemark.functions.numeric import nan_to_null, safe_div
from tidemark.operators.checks.rows import DEFAULTS, CheckConfig, check, driver_checks, emit, emit_where, union_checks
from tidemark.operators.profile import correlation_pairs, iqr_outliers, melt_numbers, per_column
from tidemark.operators.windows import change_from_last_valid


def _column() -> Column:
    return F.col("column")


def _about(text: str) -> Column:
    return F.concat(F.lit(text), _column())


def column_facts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, nulls, valid count, range and skewness of every column, in one scan."""
    numbers = set(numeric_columns(df))

    def num(c: str) -> Column:
        return nan_to_null(F.col(c).cast("double")) if c in numbers else F.lit(None).cast("double")

    return per_column(df, cols, {
        "rows": lambda c: F.count(F.lit(1)),
        "nulls": lambda c: F.count_if(F.col(c).isNull()),
        "n": lambda c: F.count(num(c)),
        "lo": lambda c: F.min(num(c)),
        "hi": lambda c: F.max(num(c)),
        "skew": lambda c: F.skewness(num(c)),
    })


def _nulls(cfg: CheckConfig) -> Column:
    ratio = safe_div("nulls", "rows")
    return check("feature_completeness", ~(ratio > cfg.missing_ratio), severity="warning", subject=_column(),
                 metric="null_ratio", value=ratio, threshold=cfg.missing_ratio,
                 good=_about("few nulls in "), bad=_about("many nulls in "))


def _distribution(cfg: CheckConfig) -> Column:
    same = F.col("lo") == F.col("hi")
    steep = F.abs("skew") > cfg.skew_limit
    return check("feature_distribution", ~same, severity="warning", subject=_column(), metric="skewness",
                 value=F.when(~same, F.col("skew")), threshold=cfg.skew_limit,
                 good=F.when(steep, _about("highly skewed: ")).otherwise(_about("normal distribution: ")),
                 bad=_about("constant values in "))


def check_feature_nulls(df: DataFrame, cols: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    return emit(column_facts(df, cols), [_nulls(cfg)])


def check_distribution(df: DataFrame, cols: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Constant columns warn; strong skew is noted. Columns with few values are skipped."""
    return emit_where(column_facts(df, cols), [(F.col("n") > cfg.min_for_distribution, _distribution(cfg))])


def check_correlation(df: DataFrame, cols: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """One row: how many column pairs correlate above the limit, and the strongest; ``strong_pairs`` has them all."""
    strong = F.abs("correlation") > cfg.corr_limit
    pair = F.concat_ws("~", "feature1", "feature2")
    facts = correlation_pairs(df, cols).agg(
        F.count_if(strong).alias("n"),
        F.max(F.when(strong, F.struct(F.abs("correlation").alias("r"), pair.alias("pair"))))["pair"].alias("strongest"))
    return emit(facts, [check("feature_correlation", F.col("n") == 0, severity="warning", subject="features",
                              metric="high_correlations", value=F.col("n"), threshold=cfg.corr_limit,
                              good="no strongly correlated features", bad="strongly correlated features",
                              details={"strongest": F.col("strongest")})])


def strong_pairs(df: DataFrame, cols: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """The column pairs that correlate above the limit, as rows (feature1, feature2, correlation)."""
    return correlation_pairs(df, cols).where(F.abs("correlation") > cfg.corr_limit)


def check_stability(df: DataFrame, cols: Sequence[str], cfg: CheckConfig = DEFAULTS, *, key, order) -> DataFrame:
    """Rows whose change from the last valid value of their series is above the limit, per column."""
    chg = change_from_last_valid(df, cols, key=key, order=order)
    facts = per_column(chg, cols, {"rows": lambda c: F.count(F.lit(1)),
                                   "extreme": lambda c: F.count_if(F.abs(f"{c}_chg") > cfg.max_change)})
    return emit_where(facts, [(F.col("rows") >= 2, check(
        "feature_stability", F.col("extreme") == 0, severity="warning", subject=_column(), metric="extreme_changes",
        value=F.col("extreme"), threshold=cfg.max_change * 100,
        good=_about("stable: "), bad=_about("extreme changes in ")))])


def check_iqr_outliers(df: DataFrame, cols: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """Share of values outside the IQR fences; informative, passes below the limit."""
    ratio = safe_div("outliers", "n")
    return emit_where(iqr_outliers(df, cols), [(F.col("n") > cfg.min_for_distribution, check(
        "feature_outliers", ratio < cfg.iqr_pass_ratio, severity="info", subject=_column(), metric="outlier_ratio",
        value=ratio, threshold=cfg.iqr_pass_ratio, good=_about("few outliers in "), bad=_about("outliers in "),
        details={"lower": F.col("lower"), "upper": F.col("upper")}))])


def validate_features(df: DataFrame, cols: Sequence[str] | None = None, cfg: CheckConfig = DEFAULTS, *,
                      key, order) -> DataFrame:
    """All feature checks on ``cols`` (default: every column but key and order)."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    cols = list(cols) if cols is not None else [
        c for c in df.columns if c not in (*keys, *orders) and not c.startswith("__")]
    numbers = [c for c in cols if c in set(numeric_columns(df))]
    parts = [emit_where(column_facts(df, cols), [
        (F.col("rows") == 0, check("data_availability", F.lit(False), severity="critical", subject=_column(),
                                   metric="record_count", value=F.col("rows"), threshold=1, bad="no features found")),
        (F.col("rows") > 0, _nulls(cfg)),
        (F.col("n") > cfg.min_for_distribution, _distribution(cfg))])]
    if len(numbers) > 1:
        parts.append(check_correlation(df, numbers, cfg))
    if numbers:
        parts.append(check_stability(df, numbers, cfg, key=key, order=order))
        parts.append(check_iqr_outliers(df, numbers, cfg))
    return union_checks(parts)


# --- rule set for a finished feature table ------------------------------------------------

# Name parts that hint at leakage.
FUTURE_WORDS = ("future", "next", "tomorrow", "forward")
TARGET_WORDS = ("target", "label", "y_true", "actual")


def check_leakage(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Column names that look into the future or at the target (schema only, no scan)."""
    rows = []
    for c in (cols if cols is not None else df.columns):
        for kind, words in (("future", FUTURE_WORDS), ("target", TARGET_WORDS)):
            hit = any(w in c.lower() for w in words)
            rows.append((f"{kind}_leakage", "error" if hit else "info", c, "name_match", float(hit), 0.0, not hit,
                         f"possible {kind} leakage" if hit else "ok"))
    return driver_checks(df.sparkSession, rows)


def zscore_facts(df: DataFrame, cols: Sequence[str], limit: float) -> DataFrame:
    """Rows, and values further than ``limit`` sample deviations from the column mean."""
    stats = per_column(df, cols, {"rows": lambda c: F.count(F.lit(1)),
                                  "mean": lambda c: F.avg(nan_to_null(F.col(c).cast("double"))),
                                  "std": lambda c: F.stddev_samp(nan_to_null(F.col(c).cast("double")))})
    z = safe_div(F.col("value") - F.col("mean"), "std")
    # One row per column name: the table's width bounds the broadcast.
    return (melt_numbers(df, cols).join(F.broadcast(stats), "column").groupBy("column", "rows")
            .agg(F.count_if(F.abs(z) > limit).alias("outliers")))


def check_zscore_share(df: DataFrame, cols: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    pct = safe_div(F.col("outliers") * 100, "rows")
    return emit(zscore_facts(df, cols, cfg.z_limit), [check(
        "zscore_share", ~(pct > cfg.outlier_pct), severity="error", subject=_column(), metric="outlier_pct", value=pct,
        threshold=cfg.outlier_pct, good=_about("few outliers in "), bad=_about("outliers in "))])


def check_pairs(df: DataFrame, cols: Sequence[str], cfg: CheckConfig = DEFAULTS) -> DataFrame:
    """One row per column pair, failed where the correlation is above the limit."""
    r = F.col("correlation")
    return emit(correlation_pairs(df, cols), [check(
        "correlated_pair", ~F.coalesce(F.abs(r) > cfg.corr_limit, F.lit(False)), severity="error",
        subject=F.concat_ws("~", "feature1", "feature2"), metric="correlation", value=r, threshold=cfg.corr_limit,
        good="ok", bad="high correlation")])


def check_features(df: DataFrame, cfg: CheckConfig = DEFAULTS, exclude: Sequence[str] = ("series", "date")) -> DataFrame:
    """Feature count, correlated pairs, z-score share and leakage by name."""
    floats = numeric_columns(df, exclude=exclude, floats_only=True)
    width = len(df.columns)
    ok = width >= cfg.min_features
    parts = [driver_checks(df.sparkSession, [(
        "feature_count", "info" if ok else "error", "features", "columns", float(width), float(cfg.min_features), ok,
        "ok" if ok else "too few features")])]
    if len(floats) > 1:
        parts.append(check_pairs(df, floats, cfg))
    if floats:
        parts.append(check_zscore_share(df, floats, cfg))
    parts.append(check_leakage(df))
    return union_checks(parts)
