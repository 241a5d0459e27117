import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import metrics as met
from tidemark.operators import profile as prof
from tidemark.operators.align import align_fanout, align_sources
from tidemark.operators.quantiles import exact_quantiles

D0 = dt.date(2025, 7, 15)


def quantile_cases():
    rng = np.random.default_rng(5)
    return {
        "uniform": list(rng.uniform(-5, 5, 700)),
        "one_value": [3.0] * 50,
        "heavy": [1.0] * 300 + list(rng.uniform(0, 2, 300)),
        "exponents": list(10.0 ** rng.uniform(-200, 200, 500)),
        "single": [4.0],
        "two": [1.0, 2.0],
    }


@pytest.mark.parametrize("small", [None, 10])
def test_exact_quantiles(spark, small):
    data = [(g, float(v)) for g, vs in quantile_cases().items() for v in vs] + [("uniform", None), ("uniform", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    probs = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)
    got = {r["g"]: r for r in exact_quantiles(df, "v", probs, group=["g"], small=small).collect()}
    for g, vs in quantile_cases().items():
        assert got[g]["n"] == len(vs)
        for p in probs:
            assert got[g]["q" + f"{p:g}".replace(".", "_")] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12), (g, p)


def test_quantiles_with_many_nodes_stay_distributed(spark, monkeypatch):
    from tidemark.operators import quantiles

    monkeypatch.setattr(quantiles, "MAX_NODES", 2)
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(700)], "g int, v double")
    got = {r["g"]: r["q0_5"] for r in exact_quantiles(df, "v", (0.5,), group=["g"], small=10).collect()}
    assert got == {g: float(np.median([i for i in range(700) if i % 7 == g])) for g in range(7)}


def test_iqr_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(20), 1000]], "x double")
    r = prof.iqr_outliers(df, ["x"]).first()
    assert (r["q1"], r["q3"], r["outliers"]) == (5.0, 15.0, 1)


def test_null_numeric_and_constant_profiles(spark):
    df = spark.createDataFrame([(1.0, None, 5, "a"), (None, None, 5, "b"), (float("nan"), None, 5, "a")], "x double, y double, k int, c string")
    nulls = {r["column"]: r["null_count"] for r in prof.null_profile(df).collect()}
    assert nulls == {"x": 1, "y": 3, "k": 0, "c": 0}
    r = prof.numeric_profile(df, ["x"]).first()
    assert (r["count"], r["mean"], r["std"], r["max"]) == (1, 1.0, None, 1.0)
    const = {r["column"]: (r["all_null"], r["is_constant"]) for r in prof.constant_columns(df, ["x", "y", "k"]).collect()}
    assert const == {"x": (False, False), "y": (True, True), "k": (False, True)}
    assert prof.completeness_score(df).first()["completeness"] == pytest.approx(1 - 4 / 12)
    assert prof.drop_sparse_columns(df, 0.5).columns == ["x", "k", "c"]


def test_duplicates_and_distinct(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a int, b string")
    assert tuple(prof.duplicate_rows(df).first()) == (4, 2)
    assert prof.distinct_rows(df).count() == 2
    assert tuple(prof.duplicate_rows(df.limit(0)).first()) == (0, 0)


def test_long_texts_compare_by_digest(spark):
    import hashlib

    long = "x" * 500
    digest = hashlib.sha256(long.encode()).hexdigest()
    df = spark.createDataFrame([(long,), (long,), (long + "y",), (digest,), (None,), (None,), ("",)], "t string")
    assert tuple(prof.duplicate_rows(df).first()) == (7, 2)


def test_correlations(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=60)
    b = 2 * a + rng.normal(size=60) * 0.1
    data = [(float(x), float(y), 1.0, None if i % 3 else float(x)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = {(r[0], r[1]): r[2] for r in prof.correlation_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 6
    assert got[("a", "b")] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert got[("a", "c")] is None and got[("a", "d")] == pytest.approx(1.0)
    assert got[("b", "d")] == pytest.approx(np.corrcoef(b[::3], a[::3])[0, 1])


def test_correlations_of_hard_values(spark):
    big, inf, nan = 1.7e308, float("inf"), float("nan")
    data = [(big * s, 1e9 + i, inf if i == 3 else nan if i == 5 else float(i), 7e15 + 0.0 * i, None) for i, s in enumerate([1, -1] * 10)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double")
    for width, narrow in ((1024, 32), (1024, 0), (2, 0)):
        got = {(r[0], r[1]): r[2] for r in prof.correlation_pairs(df, list("abcde"), width, narrow).collect()}
        assert len(got) == 10
        assert got[("b", "c")] == pytest.approx(1.0)
        assert got[("a", "b")] == pytest.approx(np.corrcoef([1, -1] * 10, range(20))[0, 1])
        assert all(got[p] is None for p in got if set(p) & {"d", "e"})
    for narrow in (32, 0):
        assert {r[2] for r in prof.correlation_pairs(df.limit(0), list("abc"), narrow=narrow).collect()} == {None}


def test_wide_correlations(spark, monkeypatch):
    monkeypatch.setattr(prof, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 60)) + rng.normal(size=(300, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    cols = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols))
    want = pd.DataFrame(x, columns=cols).corr()
    for parts in (1, 40):
        got = prof.correlation_pairs(df.repartition(parts), cols, 25).collect()
        assert len(got) == 60 * 59 // 2
        assert max(abs(r[2] - want.loc[r[0], r[1]]) for r in got) < 1e-9
    few = prof.correlation_pairs(df, cols[:8]).collect()
    assert len(few) == 28 and max(abs(r[2] - want.loc[r[0], r[1]]) for r in few) < 1e-9


def test_skewness_is_population(spark):
    v = [1.0, 1.0, 1.0, 5.0]
    x = np.array(v)
    want = ((x - x.mean()) ** 3).mean() / ((x - x.mean()) ** 2).mean() ** 1.5
    assert prof.skewness_profile(spark.createDataFrame([(i,) for i in v], "x double"), ["x"]).first()["skewness"] == pytest.approx(want)


def test_categories(spark):
    df = spark.createDataFrame([("a",)] * 25 + [("b",)] * 2 + [(None,)], "c string")
    r = prof.category_profile(df, ["c"]).first()
    assert (r["unique_values"], r["null_count"], r["max_count"], r["min_count"], r["high_cardinality"], r["imbalanced"]) == (
        3, 1, 25, 1, False, True)
    assert [t[1:4] for t in rows(prof.category_top(df, ["c"], 2), "rank")] == [("a", 25, 1), ("b", 2, 2)]


def test_source_summaries(spark):
    day, at = dt.date(2025, 1, 1), dt.datetime(2025, 1, 5)
    raw = spark.createDataFrame([("a", day, at), ("a", day, None), ("a", day + dt.timedelta(days=2), None), (None, day, at), ("b", None, None)],
                                "source string, date date, ingested_at timestamp")
    assert rows(prof.count_per_source(raw), "source") == [(None, 1), ("a", 3), ("b", 1)]
    assert rows(prof.latest_per_source(raw, only=["a", "b"]), "source") == [("a", day + dt.timedelta(days=2), at), ("b", None, None)]
    assert rows(prof.source_coverage(raw), "source")[1] == ("a", 3, day, day + dt.timedelta(days=2))
    assert rows(prof.duplicate_keys(raw), "source") == [("a", day, 2)]
    assert prof.duplicate_keys(raw.limit(0)).count() == 0


def test_align_takes_the_newest_value_of_each_column(spark):
    D = dt.date(2025, 1, 1)
    a = spark.createDataFrame([("x", D, 1.0, "p", 1), ("x", D, None, "q", 3), ("x", D, 5.0, None, 2), ("x", D, 4.0, "a", None)],
                              "series string, date date, v double, t string, at int")
    b = spark.createDataFrame([("x", D, 7.0, 2), ("x", D, 9.0, 2), ("y", D, None, 1)], "series string, date date, v double, at int")
    for first, second in ((a, b), (a.orderBy(F.desc("at")), b.orderBy("v"))):
        got = rows(align_sources({"a": first, "b": second}, how="last", by="at").select("series", "a_v", "a_t", "b_v"), "series")
        assert got == [("x", 5.0, "q", 9.0), ("y", None, None, None)]
    with pytest.raises(ValueError):
        align_sources({"a": a}, how="last")


def test_align_does_not_depend_on_source_order_or_multiply(spark):
    a = spark.createDataFrame([("s", D0, 1.0), ("s", D0, 3.0)], "series string, date date, v double")
    b = spark.createDataFrame([("s", D0, "x"), ("s", D0 + dt.timedelta(days=1), "y")], "series string, date date, w string")
    one = align_sources({"a": a, "b": b}, how="avg")
    two = align_sources({"b": b, "a": a}, how="avg").select(*one.columns)
    want = [("s", D0, 2.0, "x"), ("s", D0 + dt.timedelta(days=1), None, "y")]
    assert rows(one, "date") == rows(two, "date") == want
    assert rows(align_fanout(("a", a), {"b": b}), "date", "a_v") == [
        ("s", D0, 1.0, "x"), ("s", D0, 3.0, "x"), ("s", D0 + dt.timedelta(days=1), None, "y")]


def test_metrics(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("m", t, 1.0, "a", 1), ("m", t, 2.0, "a", 2), ("m", t + dt.timedelta(hours=5), 0.02, "b", 3)],
                               "name string, ts timestamp, value double, label string, id int")
    assert rows(met.metric_gauges(ev, ["label"], tiebreak=["id"]).select("label", "value"), "label") == [("a", 2.0), ("b", 0.02)]
    assert rows(met.metric_histogram(ev), "le") == [("m", 0.025, 1), ("m", 1.0, 1), ("m", 2.5, 1)]
    assert met.metric_retention(ev, 2, "2024-01-01 06:00:00").count() == 1
    assert tuple(met.retention_counts(ev, 2, "2024-01-01 06:00:00").first()) == ("m", 1, 2)
    assert [r[3:] for r in rows(met.metric_windows(ev, "1 hour"), "window_start")] == [(2, 3.0), (1, 0.02)]


def test_feature_families(spark):
    df = spark.createDataFrame([(n,) for n in ("a_lag_1", "a_lag_1", "a_rolling_std_3", "a_bb_upper", "news_sentiment", "oil")], "feature string")
    assert rows(prof.feature_families(df), "family") == [
        ("base", 1, 1), ("lag", 1, 2), ("rolling", 1, 1), ("sentiment", 1, 1), ("technical", 1, 1)]


def test_quantiles_end_on_extreme_values(spark):
    from tidemark.operators.quantiles import exact_quantiles

    values = [float("inf"), float("-inf"), 1.7976931348623157e308, -1.7976931348623157e308, 5e-324, 0.0, -0.0, *[7.0] * 40, *[i / 7 for i in range(100)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, "v", [0.25, 0.5, 0.75], group=[], small=3).first()
    order = sorted(values)
    for name, p in (("q0_25", 0.25), ("q0_5", 0.5), ("q0_75", 0.75)):
        at = p * (len(order) - 1)
        low = order[int(at)]
        assert abs(got[name] - (low + (order[min(int(at) + 1, len(order) - 1)] - low) * (at - int(at)))) < 1e-9


def test_quantiles_take_few_passes(spark, monkeypatch):
    from tidemark.operators import quantiles

    passes = []
    settle = quantiles._settle
    monkeypatch.setattr(quantiles, "_settle", lambda *a: passes.append(1) or settle(*a))
    rng = np.random.default_rng(5)
    for values in (10.0 ** rng.uniform(-300, -5, 60_000), 10.0 ** rng.uniform(-300, 300, 60_000) * rng.choice([-1, 1], 60_000),
                   np.concatenate([np.full(30_000, 2.5), rng.standard_cauchy(30_000)])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
        for few in (True, False):
            passes.clear()
            got = quantiles.exact_quantiles(df, "v", (0.25, 0.5, 0.99), group=[], small=40, few_groups=few).first()
            # 60,000 values to at most 40, as 10^8 to 100,000 would be
            assert len(passes) <= 5 and [got[1], got[2], got[3]] == pytest.approx(np.quantile(values, (0.25, 0.5, 0.99)).tolist(), rel=1e-12)


def test_discrete_and_estimated_quantiles(spark):
    from tidemark.operators import quantiles

    df = spark.createDataFrame([(g, float(v)) for g, n in (("a", 1), ("b", 10), ("c", 4001)) for v in range(n)] + [("d", None)], "g string, v double")
    for small in (None, 20):
        got = {r["g"]: tuple(r[2:]) for r in quantiles.exact_quantiles(df, "v", (0.0, 0.25, 0.5, 1.0), group=["g"], method="disc", small=small).collect()}
        assert got == {"a": (0.0,) * 4, "b": (0.0, 2.0, 4.0, 9.0), "c": (0.0, 1000.0, 2000.0, 4000.0)}
    for r in quantiles.approx_quantiles(df, "v", (0.25, 0.9), group=["g"]).collect():
        assert abs(r["q0_25"] - 0.25 * (r["n"] - 1)) <= 0.01 * r["n"] + 1 and abs(r["q0_9"] - 0.9 * (r["n"] - 1)) <= 0.01 * r["n"] + 1
    with pytest.raises(ValueError, match="unknown method"):
        quantiles.exact_quantiles(df, "v", (0.5,), group=[], method="near")


def test_distinct_counts(spark):
    long = "x" * 100
    data = [(i % 7, None if i % 5 == 0 else float(i % 3) * (-1 if i % 2 else 1), long + str(i % 11), [i % 2], None, f"u{i}") for i in range(3000)]
    df = spark.createDataFrame(data, "a int, b double, c string, d array<int>, e string, f string").repartition(4)
    exact = {r["column"]: r["distinct_count"] for r in prof.distinct_counts(df).collect()}
    assert exact == {"a": 7, "b": 6, "c": 11, "d": 2, "e": 1, "f": 3000}
    about = {r["column"]: r["distinct_count"] for r in prof.distinct_counts(df, exact=False).collect()}
    assert all(abs(about[c] - exact[c]) <= 0.05 * exact[c] for c in exact)
    for mode in (True, False):
        assert {r["column"]: r["distinct_count"] for r in prof.distinct_counts(df.limit(0), exact=mode).collect()} == dict.fromkeys(exact, 0)
