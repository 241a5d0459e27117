import datetime as dt
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import forecast as fct
from tidemark.plans.features import FeatureSpec, create_features, feature_columns, long_features
from tidemark.plans.full_run import full_run
from tidemark.schemas import RAW
from tidemark.sources.workdir import shared_folder

TODAY = dt.date(2025, 7, 30)
BY = {"key": ["series"], "order": "date"}


@pytest.fixture(scope="module")
def seed(spark):
    """Linear seed series: 30 days of rates and oil, weekly reserves, for two series."""
    data = []
    for series in ("a", "b"):
        for i in range(30):
            day = TODAY - dt.timedelta(days=i)
            at = dt.datetime(2025, 7, 30, 12)
            data.append(("cbn_rates", series, day, json.dumps({"central_rate": 1650.0 + 2 * i, "parallel_rate": 1700.0 + 2.5 * i}), at))
            data.append(("eia_brent", series, day, json.dumps({"price_usd": 75 + 0.5 * i}), at))
            if i % 7 == 0:
                data.append(("worldbank_reserves", series, day, json.dumps({"reserves_usd": 3.5e10 - 1e8 * i}), at))
    return spark.createDataFrame(data, RAW).repartition(4)


def test_create_features_closed_form(spark, seed):
    out = create_features(seed, FeatureSpec(), "2025-07-01", "2025-07-30")
    assert out.count() == 60 and len(out.columns) == len(set(out.columns))
    last = out.where("series = 'a' and date = '2025-07-30'").first()
    assert last["exchange_rate_lag_7"] == 1664.0 and last["rate_spread"] == 50.0
    assert last["exchange_rate_rolling_std_7"] == pytest.approx(2 * (7 * 8 / 12) ** 0.5)
    assert last["exchange_rate_rsi"] == 0.0
    assert last["exchange_rate_pct_change"] == pytest.approx(-2 / 1652 * 100)
    # Reserves are seen on the day itself; two days earlier the last value is from 2025-07-23.
    assert last["fx_reserves"] == 3.5e10
    assert out.where("series = 'a' and date = '2025-07-28'").first()["fx_reserves"] == 3.5e10 - 7e8
    for c in ("", "_lag_7", "_rsi", "_macd_signal", "_rolling_max_3", "_pct_change"):
        assert last[f"cbn_rates_central_rate{c}"] == last[f"exchange_rate{c}"], c
    assert last["cbn_rates_parallel_rate_lag_1"] == 1702.5
    assert "month_sin" in out.columns and "news_sentiment_sentiment_score_change" in out.columns


def test_series_do_not_mix(seed):
    spec = FeatureSpec(lags=(1,), windows=(3,), price_cols=["exchange_rate"])
    both = create_features(seed, spec, "2025-07-01", "2025-07-30")
    one = create_features(seed.where("series = 'b'"), spec, "2025-07-01", "2025-07-30")
    assert rows(both.where("series = 'b'"), "date") == rows(one, "date")


def test_fill_before_and_extra_step(seed):
    spec = FeatureSpec(ffill="before", lags=(1,), windows=(3,), extra=[lambda d: d.withColumn("twice", F.col("oil_price") * 2)])
    out = create_features(seed, spec, "2025-07-01", "2025-07-30")
    r = out.where("series = 'a' and date = '2025-07-29'").first()
    assert r["fx_reserves_lag_1"] == 3.5e10 - 7e8 and r["twice"] == 151.0


def test_windows_share_one_shuffle(seed):
    out = create_features(seed, FeatureSpec(), "2025-07-01", "2025-07-30")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # One exchange for all windows; the alignment has one for numbers and one for the text column.
    assert len(re.findall(r"Exchange hashpartitioning\(series#\d+, \d+", plan)) == 1
    assert plan.count("Exchange hashpartitioning") == 3
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "SinglePartition" not in plan


def test_long_features(seed):
    spec = FeatureSpec(lags=(1,), windows=(3,))
    out = create_features(seed, spec, "2025-07-01", "2025-07-30")
    cols = [c for c in feature_columns(out, spec) if "label" not in c]
    assert long_features(out, cols).where("feature = 'exchange_rate_lag_1'").count() == 58


def test_full_run(spark, seed):
    work = shared_folder(spark)
    spec = FeatureSpec(lags=(1,), windows=(3,), price_cols=["exchange_rate"])
    out = full_run(spark, seed, work, ["cbn_rates", "eia_brent", "worldbank_reserves"], spec, start="2025-07-01", end="2025-07-30",
                   as_of="2025-07-31", check_cols=["exchange_rate", "oil_price", "fx_reserves"])
    got = {r["stage"]: r for r in out.collect()}
    assert set(got) == {"raw", "features", "overall"}
    assert got["overall"]["total_checks"] == got["raw"]["total_checks"] + got["features"]["total_checks"]
    assert got["overall"]["quality_score"] == pytest.approx((got["raw"]["quality_score"] + got["features"]["quality_score"]) / 2)
    assert spark.read.parquet(f"{work}/features").count() == 60


def test_forecasts(spark):
    df = spark.createDataFrame([("s", dt.date(2025, 1, d), float(d), 2.0 * d) for d in range(1, 21)], "series string, date date, x double, y double")
    f = rows(fct.naive_forecast(df, "x", (1, 5), **BY).select("horizon", "point_forecast", "lower_bound", "upper_bound"), "horizon")
    assert f == [(1, 20.5, 20.09, 20.91), (5, 22.5, 22.05, 22.95)]
    assert fct.naive_forecast(df, "x", (1,), noise=10.0, **BY).first()["point_forecast"] != 20.5
    req = spark.createDataFrame([(0,), (1,), (5,), (6,), (None,)], "horizon int")
    assert [r["is_valid"] for r in fct.forecast_requests(req).collect()] == [False, True, True, False, False]
    top = fct.top_contributions(df, {"x": 1.0, "y": -1.0}, 1, **BY).where("date = '2025-01-20'").first()
    assert (top["feature"], top["contribution"], top["direction"]) == ("y", -19.0, "negative")
    split = {r["split"]: r["count"] for r in fct.temporal_split(df, **BY).groupBy("split").count().collect()}
    assert split == {"train": 14, "val": 4, "test": 2}
    lab = fct.horizon_labels(df, "x", (1, 5), **BY).orderBy("date").collect()
    assert (lab[0]["x_t_plus_1"], lab[0]["x_t_plus_5"], lab[-1]["x_t_plus_1"]) == (2.0, 6.0, None)
    reg = fct.horizon_regression(df, ["x"], "y", (1,), **BY).first()
    assert (reg["rows"], reg["coef_x"], reg["intercept"]) == (19, pytest.approx(2.0), pytest.approx(2.0))


def _two_series(spark, n=120):
    """y = 3 + 2a - b two rows later, with noise that is not linear in them."""
    rng = np.random.default_rng(7)
    data = []
    for s in ("p", "q"):
        a, b = rng.normal(1e6, 3.0, n), rng.normal(0, 1.0, n)
        e = rng.normal(0, 0.1, n)
        for i in range(n):
            y = None if i < 2 or i == 50 else float(3 + 2 * a[i - 2] - b[i - 2] + e[i])
            data.append((s, dt.date(2025, 1, 1) + dt.timedelta(days=i), float(a[i]), None if i == 9 else float(b[i]), 5.0, y, "train" if i < 80 else "test"))
    return spark.createDataFrame(data, "series string, date date, a double, b double, c double, y double, split string"), data


def _plain_fit(data, h):
    by = {(r[0], r[1]): r for r in data}
    parts = {"train": [], "test": []}
    for r in data:
        later = by.get((r[0], r[1] + dt.timedelta(days=h)))
        if later and later[5] is not None and r[3] is not None:
            parts[r[6]].append((r[2], r[3], later[5]))
    t, s = (np.array(parts[p]) for p in ("train", "test"))
    design = lambda m: np.column_stack([np.ones(len(m)), m[:, 0] - 1e6, m[:, 1]])
    coef = np.linalg.lstsq(design(t), t[:, 2], rcond=None)[0]
    off = s[:, 2] - design(s) @ coef
    return len(t), len(s), coef, float(np.sqrt(np.mean(off ** 2))), 1 - float(np.mean(off ** 2) / s[:, 2].var())


def test_regression_held_out_equals_least_squares(spark):
    df, data = _two_series(spark)
    on = {"train": F.col("split") == "train", "test": F.col("split") == "test"}
    got = fct.horizon_regression(df.repartition(7), ["a", "b", "c"], "y", (1, 2), **on, **BY).orderBy("horizon").collect()
    for r in got:
        n, m, coef, rmse, r2 = _plain_fit(data, r["horizon"])
        assert (r["rows"], r["test_rows"]) == (n, m)
        # a lies a million away from zero, so moments must be taken about the mean
        assert (r["coef_a"], r["coef_b"], r["coef_c"]) == (pytest.approx(coef[1], rel=1e-6), pytest.approx(coef[2], rel=1e-6), 0.0)
        assert r["intercept"] == pytest.approx(coef[0] - coef[1] * 1e6, rel=1e-6)
        assert (r["rmse"], r["r2"]) == (pytest.approx(rmse, rel=1e-5), pytest.approx(r2, abs=1e-6))
    assert got[1]["coef_a"] == pytest.approx(2.0, abs=0.02) and got[1]["rmse"] < 0.15


def test_regression_of_no_rows_collinear_and_split_series(spark, monkeypatch):
    df, data = _two_series(spark)
    empty = fct.horizon_regression(df.where("false"), ["a"], "y", (1, 2), **BY).orderBy("horizon").collect()
    assert [(r["horizon"], r["rows"], r["test_rows"], r["rmse"], r["coef_a"]) for r in empty] == [(1, 0, 0, None, None), (2, 0, 0, None, None)]
    none = fct.horizon_regression(df, ["a"], "y", (1,), train=F.lit(False), **BY).first()
    assert none["rows"] == 0 and none["test_rows"] > 0 and none["rmse"] is None
    twice = fct.horizon_regression(df.withColumn("a2", F.col("a")), ["a", "a2"], "y", (2,), **BY).first()
    once = fct.horizon_regression(df, ["a"], "y", (2,), **BY).first()
    assert twice["coef_a"] + twice["coef_a2"] == pytest.approx(once["coef_a"], rel=1e-6)
    assert twice["rmse"] == pytest.approx(once["rmse"], rel=1e-6)
    bad = df.withColumn("a", F.when(F.dayofmonth("date") == 3, float("nan")).otherwise(F.col("a")))
    assert fct.horizon_regression(bad, ["a"], "y", (2,), **BY).first()["rows"] < once["rows"]
    # blocks of ten rows give the same labels, so the same model
    monkeypatch.setattr("tidemark.operators.blocks.MAX_ROWS", 10)
    cut = fct.horizon_regression(df, ["a"], "y", (2,), **BY).first()
    assert (cut["rows"], cut["coef_a"]) == (once["rows"], pytest.approx(once["coef_a"], rel=1e-9))


def test_boosting_follows_what_is_not_linear(spark):
    data = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i % 7), float(((i + 6) % 7 - 3) ** 2)) for i in range(400)]
    df = spark.createDataFrame(data, "series string, date date, x double, y double")
    on = {"train": F.col("date") < "2020-11-01", "test": F.col("date") >= "2020-11-01"}
    tree = fct.horizon_boosting(df, ["x"], "y", (1,), depth=5, **on, **BY).first()
    line = fct.horizon_regression(df, ["x"], "y", (1,), **on, **BY).first()
    assert (tree["rows"], tree["test_rows"]) == (line["rows"], line["test_rows"])
    assert tree["rmse"] < 0.2 and line["rmse"] > 2 and tree["r2"] > 0.99
    assert fct.horizon_boosting(df, ["x"], "y", (1,), train=F.lit(False), test=F.lit(True), **BY).first()["rmse"] is None


def test_champion(spark):
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", "1", 1, 0.8, t), ("b", "1", 1, 0.9, t), ("c", "1", 2, 0.5, t + dt.timedelta(days=3))],
                               "model_name string, model_version string, horizon int, accuracy_score double, training_date timestamp")
    got = rows(fct.champion_model(df, "2025-01-04").select("horizon", "model_name", "is_stale"), "horizon")
    assert got == [(1, "b", True), (2, "c", False)]
