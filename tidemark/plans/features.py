"""From raw rows to the feature frame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import PRICE_WORDS, SENTIMENT_WORDS, columns_named, numeric_columns
from tidemark.operators.blocks import block_key, merge_blocks, one_per_day
from tidemark.operators.derived import (ALIASES, base_features, calendar_features, clean_features, cross_source_ratios,
                                        cyclical_features, drop_all_null_rows)
from tidemark.operators.indicators import (add_bollinger, add_momentum, add_sentiment, recursive_indicators,
                                           sentiment_flags)
from tidemark.operators.stage import WindowStage
from tidemark.operators.windows import LAGS, STATS, WINDOWS, add_lags, add_pct_change, add_rolling, forward_fill
from tidemark.sources.raw_store import extract_wide, range_scan
from tidemark.sources.registry import SOURCE_FIELDS

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FeatureSpec:
    """Which features to build. ``None`` columns mean: choose from the schema.

    Derived features are computed from the base columns only, so the width is
    ``base * (lags + 4 * windows + 1)`` plus the indicators, and does not grow by itself.
    """

    lags: Sequence[int] = LAGS
    windows: Sequence[int] = WINDOWS
    lag_cols: Sequence[str] | None = None
    rolling_cols: Sequence[str] | None = None
    price_cols: Sequence[str] | None = None
    sentiment_cols: Sequence[str] | None = None
    pct_cols: Sequence[str] | None = None
    sentiment_window: int = 7
    rsi: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)
    bollinger: tuple[int, float] = (20, 2.0)
    ffill: str = "after"
    extra: Sequence[Transform] = ()
    fields: Mapping[str, str] = field(default_factory=lambda: dict(SOURCE_FIELDS))
    key: Sequence[str] = ("series",)
    order: str = "date"


def create_features(raw: DataFrame, spec: FeatureSpec, start: date | str, end: date | str) -> DataFrame:
    """Scan, align, base features, indicators, lags, rolling, sentiment, changes, calendar, cleaning.

    Alignment groups to one row per (series, date); every window after it reuses that
    frame's series partitioning, so the plan has one shuffle for the alignment and one for
    all windows together.
    """
    key, order = list(spec.key), spec.order
    wide = extract_wide(range_scan(raw, start, end, list(spec.fields)), spec.fields)
    sources = [c for c in wide.columns if c not in (*key, order)]
    base = base_features(drop_all_null_rows(one_per_day(wide), sources))
    return merge_blocks(add_features(base, spec))


def add_features(base: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The feature chain on a frame with one row per (series, date).

    All features come from the base columns, so the order of the stages does not matter for
    the values: indicators that need several window passes run first, while rows are narrow,
    and everything that needs one pass shares a single one. A short name and the source
    column it stands for hold the same values, so windows are computed for the short name
    and the source's features are renamed copies in the last projection.
    """
    key, order = list(spec.key), spec.order
    by = {"key": block_key(base, key), "order": [order]}
    skip = (*key, order, "__block")
    numbers = numeric_columns(base, exclude=skip)
    names = {
        "lag": numbers if spec.lag_cols is None else spec.lag_cols,
        "rolling": numbers if spec.rolling_cols is None else spec.rolling_cols,
        "price": columns_named(base, PRICE_WORDS, exclude=skip) if spec.price_cols is None else spec.price_cols,
        "mood": columns_named(base, SENTIMENT_WORDS, exclude=skip) if spec.sentiment_cols is None else spec.sentiment_cols,
        "pct": numbers if spec.pct_cols is None else spec.pct_cols,
    }
    if spec.ffill == "before":
        base = forward_fill(base, numbers, **by)
    twin = {src: short for short, src in ALIASES.items() if {src, short} <= set(numbers)}
    once = {k: list(dict.fromkeys(twin.get(c, c) for c in v)) for k, v in names.items()}
    start = base.drop(*twin)
    narrow = recursive_indicators(start, once["price"], spec.rsi, spec.macd, **by)
    st = WindowStage(narrow, **by)
    add_lags(st, once["lag"], spec.lags)
    add_rolling(st, once["rolling"], spec.windows, STATS)
    add_bollinger(st, once["price"], *spec.bollinger)
    add_momentum(st, once["price"], (5, 10, 20), 10)
    add_sentiment(st, once["mood"], spec.sentiment_window)
    add_pct_change(st, once["pct"])
    out = sentiment_flags(st.run(), once["mood"])
    for step in spec.extra:
        out = out.transform(step)
    out = cyclical_features(calendar_features(cross_source_ratios(out), order), order)
    if spec.ffill == "after":
        out = clean_features(out, [c for c in numbers if c not in twin], **by)
    return _with_source_names(out, start.columns, twin)


def _with_source_names(df: DataFrame, base: Sequence[str], twin: Mapping[str, str]) -> DataFrame:
    """Give every source column that has a short name, and its features, back as copies."""
    longest = sorted(base, key=len, reverse=True)
    copies = []
    for src, short in twin.items():
        for c in df.columns:
            owner = next((b for b in longest if c == b or c.startswith(f"{b}_")), None)
            if owner == short and (src + c[len(short):]) not in df.columns:
                copies.append(F.col(c).alias(src + c[len(short):]))
    return df.select("*", *copies)


def feature_columns(df: DataFrame, spec: FeatureSpec) -> list[str]:
    return [c for c in df.columns if c not in (*spec.key, spec.order)]


def long_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("series", "date")) -> DataFrame:
    """(keep..., feature, value) for every non-null feature."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                               for c in cols])).alias("r")
    return df.select(*keep, rows).select(*keep, "r.*").where(F.col("value").isNotNull())
