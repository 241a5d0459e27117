"""Partitioned window features. One ``select`` per stage, so each adds one Window node."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import pct_of, safe_div
from tidemark.operators.blocks import (HALO, block_key, carry_window, last_value_carry, one_per_day, series_window,
                                       sum_carry, windowed, with_carry, without_carry)
from tidemark.operators.joins import join_same_key
from tidemark.operators.stage import WindowStage

# Default lags and rolling windows, in rows.
LAGS = (1, 2, 3, 5, 7, 14, 30)
WINDOWS = (3, 7, 14, 30)
STATS = ("mean", "std", "min", "max")

_BEFORE = (Window.unboundedPreceding, -1)
_UNTIL = (Window.unboundedPreceding, 0)


def daily_series(df: DataFrame, aggs: dict, *, key: Sequence[str], order: str) -> DataFrame:
    """Group to one row per (series, day). Map-side partial sums keep hot series cheap.

    Only a date bounds a series by the calendar; with a time of day it is counted like any other frame.
    """
    out = df.groupBy(*key, order).agg(*[c.alias(n) for n, c in aggs.items()])
    return one_per_day(out) if isinstance(out.schema[order].dataType, T.DateType) else out


def add_lags(st: WindowStage, cols: Sequence[str], lags: Sequence[int]) -> None:
    for c in cols:
        for n in lags:
            st.add(f"{c}_lag_{n}", st.lag(c, n))


def add_rolling(st: WindowStage, cols: Sequence[str], windows: Sequence[int], stats: Sequence[str]) -> None:
    for c in cols:
        for n in windows:
            for s in stats:
                st.add(f"{c}_rolling_{s}_{n}", st.full(s, c, n))


def add_pct_change(st: WindowStage, cols: Sequence[str]) -> None:
    for c in cols:
        st.add(f"{c}_pct_change", pct_of(c, st.lag(c, 1)) * 100)


@windowed(lambda a: max(a["lags"]))
def lag_features(df: DataFrame, cols: Sequence[str], lags: Sequence[int] = LAGS, *, key, order) -> DataFrame:
    """``{c}_lag_{n}``: the value ``n`` rows earlier in the series."""
    st = WindowStage(df, key, order)
    add_lags(st, cols, lags)
    return st.run()


@windowed(lambda a: max(a["windows"]) - 1)
def rolling_stats(df: DataFrame, cols: Sequence[str], windows: Sequence[int] = WINDOWS,
                  stats: Sequence[str] = STATS, *, key, order) -> DataFrame:
    """``{c}_rolling_{stat}_{n}``: null until the window holds ``n`` non-null values."""
    st = WindowStage(df, key, order)
    add_rolling(st, cols, windows, stats)
    return st.run()


@windowed(lambda a: max(a["windows"]) - 1)
def rolling_range(df: DataFrame, cols: Sequence[str], windows: Sequence[int] = WINDOWS, *, key, order) -> DataFrame:
    """``{c}_range_{n}``: rolling max minus rolling min."""
    st = WindowStage(df, key, order)
    for c in cols:
        for n in windows:
            st.add(f"{c}_range_{n}", st.full("max", c, n) - st.full("min", c, n))
    return st.run()


@windowed(lambda a: 1)
def pct_change(df: DataFrame, cols: Sequence[str], *, key, order) -> DataFrame:
    """``{c}_pct_change``: percent change from the previous row."""
    st = WindowStage(df, key, order)
    add_pct_change(st, cols)
    return st.run()


@windowed(lambda a: max(a["days"]))
def log_returns(df: DataFrame, cols: Sequence[str], days: Sequence[int] = (1, 5), *, key, order) -> DataFrame:
    """``{c}_log_return_{n}``; null unless both values are positive."""
    st = WindowStage(df, key, order)
    for c in cols:
        for n in days:
            ratio = safe_div(c, st.lag(c, n))
            st.add(f"{c}_log_return_{n}", F.when(ratio > 0, F.ln(ratio)))
    return st.run()


@windowed(lambda a: 0)
def forward_fill(df: DataFrame, cols: Sequence[str], *, key, order) -> DataFrame:
    """Replace nulls in ``cols`` by the last non-null value before them."""
    split = HALO in df.columns
    rows = with_carry(df, cols, key, **last_value_carry(order)) if split else df
    w = (carry_window if split else series_window)(key, order).rowsBetween(*_UNTIL)
    fill = {c: F.last(c, ignorenulls=True).over(w).alias(c) for c in cols}
    out = rows.select(*[fill.get(c, F.col(c)) for c in rows.columns])
    return without_carry(out) if split else out


@windowed(lambda a: 0)
def change_from_last_valid(df: DataFrame, cols: Sequence[str], *, key, order) -> DataFrame:
    """``{c}_chg``: relative change from the last non-null value; null where ``c`` is null."""
    split = HALO in df.columns
    rows = with_carry(df, cols, key, **last_value_carry(order)) if split else df
    w = (carry_window if split else series_window)(key, order).rowsBetween(*_BEFORE)
    out = rows.select("*", *[pct_of(c, F.last(c, ignorenulls=True).over(w)).alias(f"{c}_chg") for c in cols])
    return without_carry(out) if split else out


def extreme_changes(df: DataFrame, cols: Sequence[str], limit: float = 0.5, *, key, order) -> DataFrame:
    """Per series and column: rows whose change from the last valid value exceeds ``limit``."""
    keys = [key] if isinstance(key, str) else list(key)
    chg = change_from_last_valid(df, cols, key=key, order=order)
    per = chg.groupBy(*keys).agg(*[
        F.struct(F.count_if(F.abs(f"{c}_chg") > limit).alias("n"), F.max(F.abs(f"{c}_chg")).alias("top")).alias(c)
        for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in cols])).alias("r")
    return per.select(*keys, rows).select(*keys, "r.column", F.col("r.s.n").alias("extreme_changes"),
                                          F.col("r.s.top").alias("max_abs_change"))


@windowed(lambda a: 0)
def days_since_update(df: DataFrame, col: str, *, key, order) -> DataFrame:
    """``{col}_days_since_update``: days since ``col`` was last observed (0 on the day itself)."""
    day = order[0]
    seen = df.withColumn("__seen", F.when(F.col(col).isNotNull(), F.col(day)))
    filled = forward_fill(seen, ["__seen"], key=key, order=order)
    return filled.select(*df.columns, F.datediff(day, "__seen").alias(f"{col}_days_since_update"))


@windowed(lambda a: 0)
def cumulative_sum(df: DataFrame, cols: Sequence[str], *, key, order) -> DataFrame:
    """``{c}_cumulative``: running total within the series."""
    if HALO not in df.columns:
        w = series_window(key, order).rowsBetween(*_UNTIL)
        return df.select("*", *[F.sum(c).over(w).alias(f"{c}_cumulative") for c in cols])
    rows = with_carry(df, cols, key, **sum_carry())
    w = carry_window(key, order).rowsBetween(*_UNTIL)
    own = ~F.col(HALO) | F.col("__carry")
    out = rows.select("*", *[F.sum(F.when(own, F.col(c))).over(w).alias(f"{c}_cumulative") for c in cols])
    return without_carry(out)


def date_gaps(df: DataFrame, *, key, order: str, max_days: int = 1) -> DataFrame:
    """Consecutive observed dates more than ``max_days`` apart, per series.

    Dates are made distinct first, so the window holds at most one row per calendar day.
    """
    keys = [key] if isinstance(key, str) else list(key)
    days = one_per_day(df.select(*keys, order).where(F.col(order).isNotNull()).distinct())
    w = series_window(block_key(days, keys), order)
    gaps = days.select(*keys, F.lag(order).over(w).alias("start_date"), F.col(order).alias("end_date"))
    return gaps.withColumn("gap_days", F.datediff("end_date", "start_date")).where(F.col("gap_days") > max_days)


def missing_dates(df: DataFrame, *, key, order: str) -> DataFrame:
    """Calendar days between the first and last date of a series with no row."""
    keys = [key] if isinstance(key, str) else list(key)
    days = df.select(*keys, order).where(F.col(order).isNotNull()).distinct()
    spine = (days.groupBy(*keys).agg(F.min(order).alias("a"), F.max(order).alias("b"))
                 .select(*keys, F.explode(F.sequence("a", "b")).alias(order)))
    return join_same_key(spine, days, [*keys, order], "left_anti")


@windowed(lambda a: 1)
def _with_prior(df: DataFrame, col: str, *, key, order) -> DataFrame:
    return df.select("*", F.lag(col).over(series_window(key, order)).alias("__prior"))


def out_of_order_rows(df: DataFrame, date: str, *, key, seq: str) -> DataFrame:
    """Rows whose date is before that of the row stored just before them (by ``seq``)."""
    return _with_prior(df, date, key=key, order=seq).where(F.col("__prior") > F.col(date)).drop("__prior")


def zscore_outliers(df: DataFrame, cols: Sequence[str], limit: float = 3.0, *, key) -> DataFrame:
    """Rows of the long (column, value) form with ``abs(z) > limit`` within their series.

    Means and deviations come from a partial aggregate joined back on the series, not from
    a window that would hold the series; AQE splits a skewed series in the join.
    """
    keys = [key] if isinstance(key, str) else list(key)
    long = df.select("*", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("r"))
    long = long.select(*[c for c in df.columns if c not in cols and c not in ("__block", HALO)],
                       "r.column", "r.value").where(F.col("value").isNotNull())
    stats = long.groupBy(*keys, "column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    z = safe_div(F.col("value") - F.col("mean"), "std")
    return (join_same_key(long, stats, [*keys, "column"]).withColumn("z", z)
                .where(F.abs("z") > limit).drop("mean", "std"))
