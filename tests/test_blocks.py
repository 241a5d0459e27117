"""A split series must give what the whole series gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import blocks
from tidemark.operators import forecast as fct
from tidemark.operators import indicators as ind
from tidemark.operators import windows as win
from tidemark.operators.blocks import BLOCK, HALO, merge_blocks, one_per_day, split_series
from tidemark.operators.ewm import ewm_mean

BY = {"key": ["s"], "order": "date"}


@pytest.fixture(scope="module")
def series(spark):
    """One hot series, one sparse one with long gaps, one short one, and a null key; values with nulls."""
    rnd = random.Random(7)
    start, data = dt.date(2000, 1, 1), []

    def value(i):
        return None if rnd.random() < 0.15 or 200 < i < 330 else round(rnd.uniform(1, 100), 2)

    data += [("hot", start + dt.timedelta(days=i), value(i)) for i in range(1500)]
    data += [("sparse", start + dt.timedelta(days=i * 97), value(i)) for i in range(150)]
    data += [("short", start + dt.timedelta(days=i), value(i)) for i in range(5)]
    data += [(None, start + dt.timedelta(days=i), value(i)) for i in range(120)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "s string, date date, x double").repartition(4).cache()


def same(a, b):
    a, b = rows(a, "s", "date"), rows(b, "s", "date")
    assert len(a) == len(b)
    for p, q in zip(a, b):
        assert len(p) == len(q)
        for u, v in zip(p, q):
            assert u == v or (isinstance(u, float) and v is not None and u == pytest.approx(v, rel=1e-9, abs=1e-9)), (p, q)


CASES = {
    "lag": lambda d: win.lag_features(d, ["x"], **BY),
    "rolling": lambda d: win.rolling_stats(d, ["x"], **BY),
    "range": lambda d: win.rolling_range(d, ["x"], (7,), **BY),
    "pct": lambda d: win.pct_change(d, ["x"], **BY),
    "log": lambda d: win.log_returns(d, ["x"], **BY),
    "ffill": lambda d: win.forward_fill(d, ["x"], **BY),
    "last_valid": lambda d: win.change_from_last_valid(d, ["x"], **BY),
    "days_since": lambda d: win.days_since_update(d, "x", **BY),
    "cumulative": lambda d: win.cumulative_sum(d, ["x"], **BY),
    "rsi": lambda d: ind.rsi(d, ["x"], **BY),
    "bollinger": lambda d: ind.bollinger(d, ["x"], **BY),
    "momentum": lambda d: ind.momentum(d, ["x"], **BY),
    "sentiment": lambda d: ind.sentiment_features(d, ["x"], **BY),
    "regime": lambda d: ind.regime_flag(d, "x", **BY),
    "labels": lambda d: fct.horizon_labels(d, "x", (1, 5, 40), **BY),
    "ewm": lambda d: ewm_mean(d, ["x"], 5, **BY),
    "macd": lambda d: ind.macd(d, ["x"], 3, 6, 2, **BY),
}


@pytest.mark.parametrize("name", list(CASES))
def test_operator_on_hot_series(series, monkeypatch, name):
    whole = merge_blocks(CASES[name](one_per_day(series)))
    monkeypatch.setattr(blocks, "MAX_ROWS", 60)
    same(CASES[name](series), whole)


def test_blocks_are_bounded_and_complete(series):
    parts = split_series(series, lookback=10, rows=60, **BY)
    home = parts.where(~F.col(HALO))
    assert rows(home.select("s", "date", "x"), "s", "date") == rows(series, "s", "date")
    sizes = parts.where("s = 'hot'").groupBy(BLOCK).count().collect()
    assert len(sizes) > 10
    # A block holds its rows and the halo.
    assert max(r["count"] for r in sizes) <= 60 + 10


def test_small_series_are_not_touched(series):
    parts = split_series(series, lookback=10, **BY)
    assert HALO not in parts.columns and parts.count() == series.count()


def test_shuffle_join_when_part_table_is_large(series, monkeypatch):
    monkeypatch.setattr(blocks, "MAX_BROADCAST_PARTS", 0)
    monkeypatch.setattr(blocks, "MAX_ROWS", 60)
    same(win.lag_features(series, ["x"], (1, 7), **BY), merge_blocks(win.lag_features(one_per_day(series), ["x"], (1, 7), **BY)))


def test_timestamp_order_with_ties_and_no_key(spark, monkeypatch):
    base = dt.datetime(2024, 1, 1)
    data = [(base + dt.timedelta(seconds=i // 3), i, float(i % 11)) for i in range(900)]
    df = spark.createDataFrame(data, "ts timestamp, id long, x double").repartition(3)
    monkeypatch.setattr(blocks, "MAX_ROWS", 50)
    out = win.lag_features(df, ["x"], (2,), key=[], order=["ts", "id"])
    assert [r["x_lag_2"] for r in out.orderBy("id").collect()] == [None, None] + [float((i - 2) % 11) for i in range(2, 900)]


def test_equal_timestamps_are_split(spark, monkeypatch):
    data = [(dt.datetime(2024, 1, 1), i) for i in range(300)]
    df = spark.createDataFrame(data, "ts timestamp, id long")
    monkeypatch.setattr(blocks, "MAX_ROWS", 50)
    out = win.lag_features(df, ["id"], (1,), key=[], order=["ts", "id"])
    assert [r["id_lag_1"] for r in out.orderBy("id").collect()] == [None, *range(299)]


def test_a_burst_takes_three_jobs_and_small_blocks(spark):
    """20,000 rows, 500 of them at one instant; another series with a null key and a null date."""
    base = dt.datetime(2024, 1, 1)
    data = [("s", base + dt.timedelta(seconds=i if not 9000 <= i < 9500 else 9000), i) for i in range(20_000)]
    data += [(None, None if i < 3 else base + dt.timedelta(seconds=i), -i) for i in range(400)]
    df = spark.createDataFrame(data, "s string, ts timestamp, id long").repartition(6)
    written = []
    kept, blocks.stage = blocks.stage, lambda d: written.append(1) or kept(d)
    try:
        parts = split_series(df, key="s", order="ts", lookback=7, rows=300).cache()
    finally:
        blocks.stage = kept
    assert written == [1]
    sizes = parts.groupBy("s", BLOCK).agg(F.count("*").alias("n"), F.count_if(~F.col(HALO)).alias("own")).collect()
    assert max(r["n"] for r in sizes) <= 307 and max(r["own"] for r in sizes) == 300 and len(sizes) == 67 + 2
    assert parts.where(~F.col(HALO)).select("s", "ts", "id").exceptAll(df).count() == 0 and parts.where(~F.col(HALO)).count() == 20_400
    # ties have one order: the chain of lags over all blocks visits every row once
    out = win._with_prior(parts, "id", key=["s", BLOCK], order=["ts", blocks.POSITION]).where(~F.col(HALO) & (F.col("s") == "s"))
    assert out.where("__prior IS NULL").count() == 1 and out.select("__prior").distinct().count() == 20_000


def test_double_order_is_split(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 97) + i / 1000, float(i)) for i in range(400)], "t double, x double")
    monkeypatch.setattr(blocks, "MAX_ROWS", 50)
    got = [(r["x"], r["x_lag_1"]) for r in win.lag_features(df, ["x"], (1,), key=[], order="t").orderBy("t").collect()]
    assert all(a[0] == b[1] for a, b in zip(got, got[1:])) and len(got) == 400
