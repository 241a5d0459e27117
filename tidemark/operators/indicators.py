"""Technical indicators and sentiment windows on price-like series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import full_window, pct_of, safe_div
from tidemark.operators.blocks import last_rows, series_window, windowed
from tidemark.operators.ewm import ewm_columns, run_length
from tidemark.operators.stage import WindowStage


def _rsi(df: DataFrame, cols: Sequence[str], window: int, key, order) -> DataFrame:
    w = series_window(key, order)
    moved = df.select("*", *[(F.col(c) - F.lag(c, 1).over(w)).alias(f"__d_{c}") for c in cols])
    frame = last_rows(w, window)
    # Gains and losses are never null, so one row count guards them all.
    means = [F.count(F.lit(1)).over(frame).alias("__rows")]
    for c in cols:
        d = F.col(f"__d_{c}")
        means.append(F.avg(F.when(d > 0, d).otherwise(0.0)).over(frame).alias(f"__g_{c}"))
        means.append(F.avg(F.when(d < 0, -d).otherwise(0.0)).over(frame).alias(f"__l_{c}"))
    moved = moved.select("*", *means)
    full = F.col("__rows") == window
    out = []
    for c in cols:
        g, s = F.col(f"__g_{c}"), F.col(f"__l_{c}")
        # No losses: 100 is the limit of the ratio; no movement at all has no value.
        out.append(F.when(full & (s == 0) & (g > 0), F.lit(100.0))
                    .when(full, 100 - 100 / (1 + safe_div(g, s))).alias(f"{c}_rsi"))
    return moved.select(*df.columns, *out)


@windowed(lambda a: a["window"])
def rsi(df: DataFrame, cols: Sequence[str], window: int = 14, *, key, order) -> DataFrame:
    """``{c}_rsi``: simple-average RSI. A row without a previous value counts as no movement."""
    return _rsi(df, cols, window, key, order)


def _macd(df: DataFrame, cols: Sequence[str], fast: int, slow: int, signal: int, key, order) -> DataFrame:
    specs = {}
    for c in cols:
        specs[f"__f_{c}"] = (c, fast)
        specs[f"__s_{c}"] = (c, slow)
    lines = ewm_columns(df, specs, key, order)
    lines = lines.select(*df.columns, *[(F.col(f"__f_{c}") - F.col(f"__s_{c}")).alias(f"{c}_macd") for c in cols])
    lines = ewm_columns(lines, {f"{c}_macd_signal": (f"{c}_macd", signal) for c in cols}, key, order)
    return lines.select("*", *[(F.col(f"{c}_macd") - F.col(f"{c}_macd_signal")).alias(f"{c}_macd_histogram")
                               for c in cols])


def _macd_lookback(fast: int, slow: int, signal: int) -> int:
    return 2 * run_length(max(fast, slow)) + 2 * run_length(signal)


@windowed(lambda a: _macd_lookback(a["fast"], a["slow"], a["signal"]))
def macd(df: DataFrame, cols: Sequence[str], fast: int = 12, slow: int = 26, signal: int = 9, *,
         key, order) -> DataFrame:
    """``{c}_macd``, ``{c}_macd_signal`` and ``{c}_macd_histogram``."""
    return _macd(df, cols, fast, slow, signal, key, order)


def add_bollinger(st: WindowStage, cols: Sequence[str], window: int, num_std: float) -> None:
    for c in cols:
        middle, half = st.full("mean", c, window), num_std * st.full("std", c, window)
        lower, width = middle - half, 2 * half
        st.add(f"{c}_bb_middle", middle)
        st.add(f"{c}_bb_upper", middle + half)
        st.add(f"{c}_bb_lower", lower)
        st.add(f"{c}_bb_bandwidth", width)
        st.add(f"{c}_bb_percent", safe_div(F.col(c) - lower, width))


def add_momentum(st: WindowStage, cols: Sequence[str], periods: Sequence[int], roc: int) -> None:
    for c in cols:
        for n in periods:
            st.add(f"{c}_momentum_{n}", pct_of(c, st.lag(c, n)) * 100)
        st.add(f"{c}_roc_{roc}", safe_div(c, st.lag(c, roc)) - 1)


def add_sentiment(st: WindowStage, cols: Sequence[str], window: int) -> None:
    for c in cols:
        st.add(f"{c}_rolling_mean", st.full("mean", c, window))
        st.add(f"{c}_rolling_std", st.full("std", c, window))
        st.add(f"{c}_change", F.col(c) - st.lag(c, 1))
        st.add(f"{c}_momentum", F.col(c) - st.lag(c, window))


@windowed(lambda a: a["window"] - 1)
def bollinger(df: DataFrame, cols: Sequence[str], window: int = 20, num_std: float = 2.0, *,
              key, order) -> DataFrame:
    """``{c}_bb_middle/upper/lower/bandwidth/percent``."""
    st = WindowStage(df, key, order)
    add_bollinger(st, cols, window, num_std)
    return st.run()


@windowed(lambda a: max(*a["periods"], a["roc"]))
def momentum(df: DataFrame, cols: Sequence[str], periods: Sequence[int] = (5, 10, 20), roc: int = 10, *,
             key, order) -> DataFrame:
    """``{c}_momentum_{n}`` in percent and ``{c}_roc_{n}`` as a fraction."""
    st = WindowStage(df, key, order)
    add_momentum(st, cols, periods, roc)
    return st.run()


def recursive_indicators(df: DataFrame, cols: Sequence[str], rsi: int, macd: tuple[int, int, int], key, order) -> DataFrame:
    """RSI and MACD, which need several window passes: run them while the frame is narrow."""
    return _macd(_rsi(df, cols, rsi, key, order), cols, *macd, key, order) if cols else df


@windowed(lambda a: max(a["rsi"], _macd_lookback(*a["macd"]), a["bb"][0] - 1, 20))
def technical_indicators(df: DataFrame, cols: Sequence[str], rsi: int = 14,
                         macd: tuple[int, int, int] = (12, 26, 9), bb: tuple[int, float] = (20, 2.0), *,
                         key, order) -> DataFrame:
    """RSI, MACD, Bollinger bands and momentum of every column in ``cols``."""
    st = WindowStage(recursive_indicators(df, cols, rsi, macd, key, order), key, order)
    add_bollinger(st, cols, *bb)
    add_momentum(st, cols, (5, 10, 20), 10)
    return st.run()


@windowed(lambda a: a["window"])
def sentiment_features(df: DataFrame, cols: Sequence[str], window: int = 7, *, key, order) -> DataFrame:
    """Rolling mean and std, change, momentum over ``window`` rows, and the three flags."""
    st = WindowStage(df, key, order)
    add_sentiment(st, cols, window)
    return sentiment_flags(st.run(), cols)


def sentiment_flags(df: DataFrame, cols: Sequence[str], strong: float = 0.7, flat: float = 0.1) -> DataFrame:
    """``{c}_very_positive``, ``{c}_very_negative`` and ``{c}_neutral``."""
    return df.select("*", *[x for c in cols for x in (
        (F.col(c) > strong).alias(f"{c}_very_positive"),
        (F.col(c) < -strong).alias(f"{c}_very_negative"),
        (F.abs(c) < flat).alias(f"{c}_neutral"))])


def sentiment_bucket(df: DataFrame, col: str, negative: float = -0.1, positive: float = 0.1) -> DataFrame:
    """``{col}_bucket``: negative, neutral or positive."""
    x = F.col(col)
    return df.withColumn(f"{col}_bucket", F.when(x < negative, "negative").when(x > positive, "positive")
                         .when(x.isNotNull(), "neutral"))


@windowed(lambda a: a["window"])
def regime_flag(df: DataFrame, col: str, window: int = 14, fixed: float = 0.005, managed: float = 0.05, *,
                key, order) -> DataFrame:
    """``{col}_volatility`` (rolling std of relative change) and ``{col}_regime`` by two limits."""
    w = series_window(key, order)
    moved = df.select("*", pct_of(col, F.lag(col, 1).over(w)).alias("__chg"))
    vol = moved.select(*df.columns, full_window(F.stddev_samp, "__chg", last_rows(w, window), window)
                       .alias(f"{col}_volatility"))
    v = F.col(f"{col}_volatility")
    return vol.withColumn(f"{col}_regime", F.when(v <= fixed, "fixed").when(v <= managed, "managed_float")
                          .when(v.isNotNull(), "flexible"))
