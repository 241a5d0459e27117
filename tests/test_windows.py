import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from conftest import rows
from tidemark.functions.calendar import month_start
from tidemark.operators import derived
from tidemark.operators import indicators as ind
from tidemark.operators import windows as win
from tidemark.operators.ewm import ewm_mean

BY = {"key": ["s"], "order": "date"}
D0 = dt.date(2025, 7, 15)


def frame(spark, values, s="a", step=1):
    return spark.createDataFrame([(s, D0 + dt.timedelta(days=i * step), v) for i, v in enumerate(values)],
                                 "s string, date date, x double")


def col(df, name):
    return [r[name] for r in df.orderBy("s", "date").collect()]


def test_lag_counts_rows_not_days(spark):
    df = frame(spark, [1.0, 2.0, 3.0], step=5).union(frame(spark, [9.0], s="b"))
    assert col(win.lag_features(df, ["x"], (1, 2), **BY), "x_lag_1") == [None, 1.0, 2.0, None]


def test_rolling_needs_full_window(spark):
    out = win.rolling_stats(frame(spark, [1.0, None, 3.0, 5.0]), ["x"], (2,), **BY)
    assert col(out, "x_rolling_mean_2") == [None, None, None, 4.0]
    assert col(out, "x_rolling_min_2") == [None, None, None, 3.0]
    assert col(out, "x_rolling_std_2")[3] == pytest.approx(math.sqrt(2))


def test_rolling_order_and_closed_form(spark):
    n, slope = 14, 2.5
    out = win.rolling_stats(frame(spark, [1700 + slope * i for i in range(40)]), ["x"], (n,), **BY).orderBy("date").collect()
    for r in out[n - 1:]:
        assert r[f"x_rolling_std_{n}"] == pytest.approx(slope * math.sqrt(n * (n + 1) / 12))
        assert r[f"x_rolling_min_{n}"] <= r[f"x_rolling_mean_{n}"] <= r[f"x_rolling_max_{n}"]


def test_rsi_limits(spark):
    assert col(ind.rsi(frame(spark, [float(i) for i in range(16)]), ["x"], 3, **BY), "x_rsi")[:4] == [None, None, 100.0, 100.0]
    assert col(ind.rsi(frame(spark, [float(-i) for i in range(6)]), ["x"], 3, **BY), "x_rsi")[2:] == [0.0] * 4
    assert col(ind.rsi(frame(spark, [5.0] * 5), ["x"], 3, **BY), "x_rsi") == [None] * 5


def test_rsi_by_hand(spark):
    # Changes: none, +10, -5, +15 over 3 rows: the last window holds +10, -5, +15.
    assert col(ind.rsi(frame(spark, [1500.0, 1510.0, 1505.0, 1520.0]), ["x"], 3, **BY), "x_rsi")[3] == pytest.approx(
        100 - 100 / (1 + 25 / 5))


@pytest.mark.parametrize("span", [1, 2, 9, 12, 26, 200])
def test_ewm_matches_pandas(spark, span):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=1300)) + 100
    x[rng.random(1300) < 0.2] = np.nan
    x[400:960] = np.nan
    want = pd.Series(x).ewm(span=span, adjust=True, ignore_na=False).mean().where(~np.isnan(x))
    vals = [None if np.isnan(v) else float(v) for v in x]
    got = col(ewm_mean(frame(spark, vals), ["x"], span, **BY), f"x_ewm_{span}")
    for g, w in zip(got, want):
        assert (g is None and np.isnan(w)) or g == pytest.approx(w, rel=1e-11)


def test_ewm_of_constant(spark):
    assert col(ewm_mean(frame(spark, [7.0] * 50), ["x"], 12, **BY), "x_ewm_12") == pytest.approx([7.0] * 50)


def test_macd_matches_pandas(spark):
    x = pd.Series([100 + 10 * math.sin(i / 5) + i * 0.1 for i in range(300)])
    line = x.ewm(span=12).mean() - x.ewm(span=26).mean()
    signal = line.ewm(span=9).mean()
    out = ind.macd(frame(spark, list(x)), ["x"], **BY)
    assert col(out, "x_macd") == pytest.approx(list(line))
    assert col(out, "x_macd_signal") == pytest.approx(list(signal))
    assert col(out, "x_macd_histogram") == pytest.approx(list(line - signal), abs=1e-9)


def test_bollinger_constant_has_no_percent(spark):
    out = ind.bollinger(frame(spark, [4.0] * 5), ["x"], 3, **BY)
    assert col(out, "x_bb_middle")[2:] == [4.0] * 3 and col(out, "x_bb_percent") == [None] * 5


def test_momentum_zero_denominator(spark):
    out = ind.momentum(frame(spark, [0.0, 5.0, 10.0]), ["x"], (1,), 2, **BY)
    assert col(out, "x_momentum_1") == [None, None, 100.0] and col(out, "x_roc_2") == [None, None, None]


def test_pct_change_and_last_valid(spark):
    df = frame(spark, [10.0, None, 20.0, 0.0, 5.0])
    assert col(win.pct_change(df, ["x"], **BY), "x_pct_change") == [None, None, None, -100.0, None]
    assert col(win.change_from_last_valid(df, ["x"], **BY), "x_chg") == [None, None, 1.0, -1.0, None]
    got = win.extreme_changes(df, ["x"], **BY).first()
    assert (got["extreme_changes"], got["max_abs_change"]) == (2, 1.0)


def test_forward_fill_is_idempotent(spark):
    df = frame(spark, [None, 1.0, None, None, 2.0])
    once = win.forward_fill(df, ["x"], **BY)
    assert col(once, "x") == [None, 1.0, 1.0, 1.0, 2.0]
    assert rows(win.forward_fill(once, ["x"], **BY), "date") == rows(once, "date")


def test_gaps_and_missing_dates(spark):
    days = [D0 + dt.timedelta(days=i) for i in (0, 1, 1, 4, 6)]
    df = spark.createDataFrame([("a", d) for d in days] + [("b", D0)], "s string, date date")
    assert rows(win.date_gaps(df, **BY), "start_date") == [
        ("a", days[1], days[3], 3), ("a", days[3], days[4], 2)]
    assert [r[1] for r in rows(win.missing_dates(df, **BY), "date")] == [
        D0 + dt.timedelta(days=i) for i in (2, 3, 5)]


def test_out_of_order(spark):
    df = spark.createDataFrame([("a", 1, D0), ("a", 2, D0 + dt.timedelta(days=2)), ("a", 3, D0 + dt.timedelta(days=1)),
                                ("b", 4, D0)], "s string, n int, date date")
    assert rows(win.out_of_order_rows(df, "date", key="s", seq="n"), "n") == [("a", 3, D0 + dt.timedelta(days=1))]


def test_days_since_update(spark):
    assert col(win.days_since_update(frame(spark, [None, 1.0, None, None], step=2), "x", **BY), "x_days_since_update") == [None, 0, 2, 4]


def test_zscore_and_cumulative(spark):
    df = frame(spark, [1.0] * 20 + [50.0])
    assert [r["value"] for r in win.zscore_outliers(df, ["x"], key="s").collect()] == [50.0]
    assert col(win.cumulative_sum(frame(spark, [1.0, None, 2.0]), ["x"], **BY), "x_cumulative") == [1.0, 1.0, 3.0]


def test_sentiment(spark):
    out = ind.sentiment_features(frame(spark, [0.8, -0.8, 0.05, 0.3]), ["x"], 2, **BY)
    assert col(out, "x_very_positive") == [True, False, False, False]
    assert col(out, "x_very_negative") == [False, True, False, False]
    assert col(out, "x_neutral") == [False, False, True, False]
    assert col(out, "x_momentum")[2] == pytest.approx(-0.75)
    assert col(ind.sentiment_bucket(out, "x"), "x_bucket") == ["positive", "negative", "neutral", "positive"]


def test_regime(spark):
    out = ind.regime_flag(frame(spark, [100.0] * 4 + [150.0, 80.0]), "x", 2, 0.01, 0.3, **BY)
    assert col(out, "x_regime") == [None, None, "fixed", "fixed", "flexible", "flexible"]


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 29),)], "date date")
    r = derived.calendar_flags(derived.cyclical_features(derived.calendar_features(df))).first()
    assert (r["weekday"], r["day_of_year"], r["quarter"], r["is_weekend"], r["is_december"]) == (7, 364, 4, True, True)
    assert r["month_sin"] ** 2 + r["month_cos"] ** 2 == pytest.approx(1)
    assert spark.createDataFrame([("2024-03",)], "m string").select(month_start("m")).first()[0] == dt.date(2024, 3, 1)


def test_base_and_ratio_features_skip_absent_inputs(spark):
    df = spark.createDataFrame([(100.0, 150.0, 0.0)], "cbn_rates_central_rate double, cbn_rates_parallel_rate double, eia_brent_price_usd double")
    out = derived.cross_source_ratios(derived.base_features(df))
    r = out.first()
    assert (r["rate_spread"], r["rate_premium"], r["exchange_rate_per_oil"], r["oil_price_ngn"]) == (50.0, 0.5, None, 0.0)
    assert "reserves_to_debt_ratio" not in out.columns and "total_debt" not in out.columns


def test_empty_and_single_row(spark):
    for values in ([], [3.0]):
        df = frame(spark, values)
        for out in (win.lag_features(df, ["x"], **BY), win.rolling_stats(df, ["x"], **BY), ind.technical_indicators(df, ["x"], **BY),
                    win.forward_fill(df, ["x"], **BY)):
            assert out.count() == len(values)


def test_null_series_is_a_series(spark):
    df = spark.createDataFrame([(None, D0, 1.0), (None, D0 + dt.timedelta(days=2), 5.0)], "s string, date date, x double")
    assert [r["date"] for r in win.missing_dates(df, **BY).collect()] == [D0 + dt.timedelta(days=1)]
    assert win.zscore_outliers(df, ["x"], 0.5, key="s").count() == 2
