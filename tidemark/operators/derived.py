"""Projections: base aliases, ratios, calendar columns and row cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_flag_parts, calendar_parts, cyclical_parts
from tidemark.functions.columns import numeric_columns
from tidemark.functions.numeric import safe_div
from tidemark.operators.windows import forward_fill, pct_change


def rate_spread_premium(df: DataFrame, central: str, parallel: str) -> DataFrame:
    """``exchange_rate``, ``parallel_rate``, ``rate_spread``, ``rate_premium``, ``rate_spread_pct``."""
    c, p = F.col(central), F.col(parallel)
    return df.withColumns({
        "exchange_rate": c, "parallel_rate": p, "rate_spread": p - c,
        "rate_premium": safe_div(p, c) - 1, "rate_spread_pct": safe_div(p - c, c) * 100,
    })


def debt_ratio(df: DataFrame, total: str, external: str, servicing: str) -> DataFrame:
    """``total_debt``, ``external_debt``, ``debt_servicing`` and ``external_debt_ratio``."""
    return df.withColumns({
        "total_debt": F.col(total), "external_debt": F.col(external), "debt_servicing": F.col(servicing),
        "external_debt_ratio": safe_div(external, total),
    })


# Short names of source columns.
ALIASES = {
    "exchange_rate": "cbn_rates_central_rate",
    "parallel_rate": "cbn_rates_parallel_rate",
    "oil_price": "eia_brent_price_usd",
    "total_debt": "dmo_debt_total_debt",
    "external_debt": "dmo_debt_external_debt",
    "debt_servicing": "dmo_debt_debt_servicing",
    "fx_reserves": "worldbank_reserves_reserves_usd",
    "sentiment_score": "news_sentiment_sentiment_score",
    "relevance_score": "news_sentiment_relevance_score",
}


def base_features(df: DataFrame) -> DataFrame:
    """Aliases and first ratios of the aligned source columns that are present."""
    have = set(df.columns)
    if {"cbn_rates_central_rate", "cbn_rates_parallel_rate"} <= have:
        df = rate_spread_premium(df, "cbn_rates_central_rate", "cbn_rates_parallel_rate")
    if {"dmo_debt_total_debt", "dmo_debt_external_debt", "dmo_debt_debt_servicing"} <= have:
        df = debt_ratio(df, "dmo_debt_total_debt", "dmo_debt_external_debt", "dmo_debt_debt_servicing")
    return df.withColumns({new: F.col(old) for new, old in ALIASES.items() if old in have and new not in df.columns})


def cross_source_ratios(df: DataFrame) -> DataFrame:
    """Ratios between sources, each only when both inputs are present."""
    have, out = set(df.columns), {}
    if {"exchange_rate", "oil_price"} <= have:
        out["exchange_rate_per_oil"] = safe_div("exchange_rate", "oil_price")
        out["oil_price_ngn"] = F.col("oil_price") * F.col("exchange_rate")
        out["oil_to_fx_ratio"] = safe_div("oil_price", "exchange_rate")
    if {"fx_reserves", "total_debt"} <= have:
        out["reserves_to_debt_ratio"] = safe_div("fx_reserves", "total_debt")
    return df.withColumns(out) if out else df


def derived_features(df: DataFrame, cols: Sequence[str], *, key, order) -> DataFrame:
    """Percent changes of ``cols`` and the cross-source ratios."""
    return cross_source_ratios(pct_change(df, cols, key=key, order=order))


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(calendar_parts(date))


def cyclical_features(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(cyclical_parts(date))


def calendar_flags(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(calendar_flag_parts(date))


def drop_all_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows where at least one of ``cols`` is not null."""
    some = F.lit(False)
    for c in cols:
        some = some | F.col(c).isNotNull()
    return df.where(some)


def clean_features(df: DataFrame, cols: Sequence[str], *, key, order) -> DataFrame:
    """Drop rows empty in ``cols``, then forward-fill every number column."""
    kept = drop_all_null_rows(df, cols)
    fill = numeric_columns(kept, exclude=("__block",))
    return forward_fill(kept, fill, key=key, order=order)
