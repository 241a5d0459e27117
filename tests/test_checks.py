import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.checks import features as fc
from tidemark.operators.checks import raw as rc
from tidemark.operators.checks import tables as tc
from tidemark.operators.checks.rows import CheckConfig, driver_checks, report, score_validation, union_checks
from tidemark.schemas import CHECK, RAW

AS_OF = "2025-07-18"
D0 = dt.date(2025, 7, 13)


def result(df):
    """(check_name, subject) -> (passed, severity, value)"""
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in CHECK]
    return {(r["check_name"], r["subject"]): (r["passed"], r["severity"], r["value"]) for r in df.collect()}


def raw(spark, source="cbn_rates", n=12, step=1, hours_old=1, data=None, start=D0):
    return spark.createDataFrame([
        (source, "all", start + dt.timedelta(days=i * step), data(i) if data else json.dumps({"value": 100 + 10 * i}),
         dt.datetime(2025, 7, 18) - dt.timedelta(hours=hours_old + i)) for i in range(n)], RAW)


def test_raw_checks_pass_on_clean_rows(spark):
    got = result(rc.validate_raw(raw(spark), ["cbn_rates"], AS_OF))
    assert all(v[0] for v in got.values()) and len(got) == 8


def test_raw_checks_fail(spark):
    df = raw(spark, n=5, step=3, hours_old=49).unionByName(raw(spark, n=1, hours_old=60, data=lambda i: None))
    got = result(rc.validate_raw(df, ["cbn_rates", "eia_brent"], AS_OF))
    assert got[("data_completeness", "cbn_rates")] == (False, "warning", 6.0)
    assert got[("data_completeness", "eia_brent")] == (False, "warning", 0.0)
    assert got[("data_freshness", "cbn_rates")] == (False, "warning", 49.0)
    assert got[("data_freshness", "eia_brent")][0] is False
    assert got[("data_consistency", "cbn_rates")] == (False, "warning", 1.0)
    assert got[("data_continuity", "cbn_rates")] == (False, "warning", 4.0)
    assert got[("data_quality", "cbn_rates")][:2] == (False, "error")
    assert ("data_continuity", "eia_brent") not in got and ("data_quality", "eia_brent") not in got


def test_check_rows_name_their_evidence(spark):
    df = raw(spark, n=5, step=3).unionByName(raw(spark, n=2, hours_old=9)).unionByName(raw(spark, source="x", n=1))
    details = {(r["check_name"], r["subject"]): r["details"] for r in rc.validate_raw(df, ["cbn_rates"], AS_OF).collect()}
    assert details[("data_consistency", "cbn_rates")] == {"dates": "2025-07-13"}
    assert details[("data_continuity", "cbn_rates")] == {"missing": "2025-07-15..2025-07-15,2025-07-17..2025-07-18,2025-07-20..2025-07-21,2025-07-23..2025-07-24"}
    assert details[("data_consistency", "x")] == {"dates": None}
    two = CheckConfig(evidence_dates=2)
    cut = {(r["check_name"], r["subject"]): r["details"] for r in rc.validate_raw(df, ["cbn_rates"], AS_OF, two).collect()}
    assert cut[("data_continuity", "cbn_rates")] == {"missing": "2025-07-15..2025-07-15,2025-07-17..2025-07-18"}


def test_outlier_evidence_is_cut_ordered_and_equal_from_facts(spark):
    values = [5.0] * 300 + [60.0, -70.0, 60.0, 80.0, 75.0]
    df = spark.createDataFrame([("s", "all", D0, json.dumps({"v": v}), None) for v in values], RAW)
    cfg = CheckConfig(ranges={"s": (0.0, 5.0)}, evidence_outliers=3, evidence_ranges=2)
    batch = rc.outlier_facts(df, ["s"], cfg).first()
    assert (batch["outliers"], batch["out_of_range"]) == (5, 5)
    # a value met twice is named once; the furthest from the mean of 5.5 come first
    assert (batch["outlier_values"], batch["range_values"]) == ("-70.0,80.0,75.0", "-70.0,60.0")
    half = [rc.value_facts(df.where(c), ["s"]) for c in ("data LIKE '%5.0%'", "data NOT LIKE '%5.0%'")]
    facts = rc.outliers_of_values(rc.merge_values(half[0].unionByName(half[1])), cfg).first()
    assert facts.asDict() | {"max_abs_z": 0} == batch.asDict() | {"max_abs_z": 0}
    calm = rc.outlier_facts(df.where("data LIKE '%5.0%' AND data NOT LIKE '%75%'"), ["s"], cfg).first()
    assert (calm["outliers"], calm["outlier_values"], calm["range_values"]) == (0, None, None)


def test_series_evidence(spark):
    days = [D0, D0, None, None, D0 + dt.timedelta(days=4)]
    df = spark.createDataFrame([("a", d) for d in days], "series string, date date")
    got = {r["check_name"]: r["details"] for r in tc.check_time_series(df, "date", AS_OF, key=["series"]).collect()}
    assert (got["unique_dates"], got["missing_dates"]) == ({"dates": "2025-07-13"}, {"missing": "2025-07-14..2025-07-16"})


def test_null_payload_is_a_warning_below_ten_percent(spark):
    df = raw(spark, n=11, data=lambda i: None if i == 0 else "{}")
    assert result(rc.check_null_payload(df, ["cbn_rates"]))[("data_quality", "cbn_rates")][:2] == (False, "warning")


def test_empty_raw_is_critical(spark):
    got = result(rc.validate_raw(raw(spark).limit(0), ["cbn_rates"], AS_OF))
    assert got[("data_availability", "raw_data")] == (False, "critical", 0.0)
    assert result(rc.check_availability(raw(spark).limit(0)))[("data_availability", "raw_data")][1] == "critical"


def test_iso_text_ingest_times(spark):
    df = spark.createDataFrame([("cbn_rates", "all", D0, "{}", t) for t in ("2025-07-16T12:00:00Z", "2025-07-17T00:00:00", "soon")],
                               "source string, series string, date date, data string, ingested_at string")
    got = result(rc.check_freshness(df, ["cbn_rates"], AS_OF))
    assert got[("data_freshness", "cbn_rates")] == (True, "info", 24.0)


def test_outliers_count_json_numbers_only(spark):
    df = raw(spark, n=40, data=lambda i: json.dumps({"v": 5000 if i == 7 else 150 + i % 3, "text": "900000", "flag": True, "deep": {"v": 9e9}}))
    got = result(rc.validate_raw(df, ["cbn_rates"], AS_OF))
    assert got[("outlier_detection", "cbn_rates")] == (False, "warning", 1.0)
    assert got[("range_validation", "cbn_rates")] == (False, "error", 1.0)
    assert [r["value"] for r in rc.outlier_values(df, ["cbn_rates"]).collect()] == [5000.0]


def test_constant_numbers_have_no_outliers(spark):
    df = raw(spark, data=lambda i: json.dumps({"v": 150}))
    assert result(rc.check_raw_outliers(df, ["cbn_rates"]))[("outlier_detection", "cbn_rates")][0] is True


def test_ingest_quality(spark):
    good = raw(spark, data=lambda i: json.dumps({"date": "d", "currency": "USD", "official_rate": 100}))
    spike = raw(spark, "spiky", data=lambda i: json.dumps({"official_rate": 500 if i == 2 else 100}))
    negative = raw(spark, "eia_brent", data=lambda i: json.dumps({"date": "d", "price_usd": -1}))
    missing = raw(spark, "news_sentiment", data=lambda i: json.dumps({"date": "d", "title": None if i == 0 else "t", "sentiment_score": 1}))
    df = good.unionByName(spike).unionByName(negative).unionByName(missing)
    names = ["cbn_rates", "spiky", "eia_brent", "news_sentiment", "dmo_debt"]
    facts = rc.recent_facts(df, names, AS_OF, "official_rate", "price_usd", ("cbn_rates", "spiky"), ("eia_brent",))
    got = {r["source"]: (r["data_availability"], r["completeness"], r["consistency"], r["overall_status"])
           for r in rc.ingest_quality(facts).collect()}
    assert got == {"cbn_rates": ("pass", "pass", "pass", "pass"), "spiky": ("pass", "pass", "warning", "warning"),
                   "eia_brent": ("pass", "pass", "warning", "warning"), "news_sentiment": ("pass", "fail", "pass", "fail"),
                   "dmo_debt": ("fail", None, None, "fail")}
    fields = rc.required_field_checks(facts).where("not passed").collect()
    assert [(r["subject"], r["details"]["fields"]) for r in fields] == [("news_sentiment", "title")]


def test_source_health(spark):
    df = raw(spark).unionByName(raw(spark, "old", hours_old=100))
    got = {r["source"]: r["health"] for r in rc.source_health(df, ["cbn_rates", "old", "none"], AS_OF).collect()}
    assert got == {"cbn_rates": "ok", "old": "degraded", "none": "error"}


def features(spark, n=30):
    return spark.createDataFrame([("s", D0 + dt.timedelta(days=i), float(i + 1), 2.0 * i, 7.0, None if i < 5 else 1.0 * (i % 4),
                                   1000.0 if i == 20 else float(i % 3)) for i in range(n)],
                                 "series string, date date, a double, b double, c double, d double, e double")


def test_feature_checks(spark):
    got = result(fc.validate_features(features(spark), key=["series"], order="date"))
    assert got[("feature_completeness", "d")][:2] == (False, "warning") and got[("feature_completeness", "a")][0]
    assert got[("feature_distribution", "c")][:2] == (False, "warning")
    assert got[("feature_distribution", "e")][0] and got[("feature_distribution", "e")][2] > 2
    assert got[("feature_correlation", "features")] == (False, "warning", 1.0)
    assert got[("feature_stability", "e")][0] is False and got[("feature_stability", "c")][0]
    assert got[("feature_outliers", "e")][0] and got[("feature_outliers", "e")][2] == pytest.approx(1 / 30)


def test_few_rows_skip_distribution_and_outliers(spark):
    names = {k[0] for k in result(fc.validate_features(features(spark, 3), key="series", order="date"))}
    assert "feature_distribution" not in names and "feature_outliers" not in names and "feature_completeness" in names
    empty = result(fc.validate_features(features(spark).limit(0), key="series", order="date"))
    assert empty[("data_availability", "a")][1] == "critical" and ("feature_stability", "a") not in empty


def test_leakage_names(spark):
    df = spark.createDataFrame([], "next_price double, target double, rate double, actual_forward double")
    bad = {k for k, v in result(fc.check_leakage(df)).items() if not v[0]}
    assert bad == {("future_leakage", "next_price"), ("target_leakage", "target"), ("future_leakage", "actual_forward"),
                   ("target_leakage", "actual_forward")}


def test_rule_sets(spark):
    df = features(spark)
    got = result(tc.validate(df, "features", key=["series"]))
    assert got[("feature_count", "features")] == (False, "error", 7.0)
    assert got[("correlated_pair", "a~b")][:2] == (False, "error")
    assert got[("constant_column", "c")][:2] == (False, "error")
    with pytest.raises(ValueError):
        tc.validate(df, "nonsense")
    with pytest.raises(ValueError):
        tc.validate(df, "time_series")


def test_rates(spark):
    df = spark.createDataFrame([("s", D0 + dt.timedelta(days=i), o, p) for i, (o, p) in enumerate([(150.0, 200.0), (-5.0, 210.0), (160.0, 2100.0)])],
                               "series string, date date, official_rate double, parallel_rate double")
    got = result(tc.validate(df, "rates", key=["series"]))
    failed = {k for k, v in got.items() if not v[0]}
    assert failed == {("min_rows", "table"), ("negative_rate", "official_rate"), ("minimum_rate", "official_rate"),
                      ("maximum_rate", "parallel_rate"), ("daily_change", "official_rate"), ("daily_change", "parallel_rate"),
                      ("rate_spread", "official_rate")}
    none = tc.check_rates(spark.createDataFrame([(1.0, D0)], "x double, date date"), key=[], order="date")
    assert result(none)[("rate_columns", "table")][0] is False


def test_time_series(spark):
    days = [0, 1, 1, 4, 30]
    df = spark.createDataFrame([("s", i, D0 + dt.timedelta(days=d)) for i, d in enumerate([1, 0, 1, 4, 30])], "series string, n int, date date")
    got = result(tc.check_time_series(df, "date", AS_OF, key=["series"], seq="n"))
    assert got[("unique_dates", "s")] == (False, "error", 1.0)
    assert got[("missing_dates", "s")] == (False, "error", 31.0 - len(set(days)))
    assert got[("future_dates", "s")] == (False, "error", 1.0)
    assert got[("sorted_dates", "s")] == (False, "error", 1.0)
    assert got[("stale_data", "s")][0] is True
    whole = result(tc.check_time_series(df, "date", "2025-09-01", seq="n"))
    assert whole[("stale_data", "series")] == (False, "error", 20.0) and whole[("sorted_dates", "series")][2] == 1.0
    assert result(tc.check_time_series(df, "day", AS_OF))[("date_column", "day")][0] is False


def test_series_v2(spark):
    df = spark.createDataFrame([(D0,), (D0,), (None,), (D0 + dt.timedelta(days=2),)], "date date")
    got = result(tc.check_series_v2(df, "date", "2025-08-01"))
    assert got[("null_dates", "date")] == (False, "error", 1.0)
    assert got[("duplicate_dates", "date")] == (False, "warning", 1.0)
    assert got[("staleness", "date")] == (False, "error", 17.0) and got[("date_range", "date")][2] == 2.0
    assert result(tc.check_series_v2(df.select(F.col("date").cast("string").alias("date")), "date", AS_OF))[("date_type", "date")][0] is False


def test_table_rules_and_scores(spark):
    df = spark.createDataFrame([(1, None)] * 3 + [(2, "x")] * 17, "a int, b string")
    got = result(tc.check_table(df))
    assert got[("table_nulls", "table")] == (True, "info", pytest.approx(7.5))
    assert got[("table_duplicates", "table")] == (False, "error", pytest.approx(90.0))
    q = tc.score_quality(df, AS_OF).first()
    assert (q["errors"], q["warnings"]) == (1, 0)
    assert q["quality_score"] == pytest.approx(0.4 * 0.925 + 0.6 * 0.8)
    assert tc.score_quality(df.limit(0), AS_OF).first()["quality_score"] == 0.0


def test_numeric_rules(spark):
    vals = [float(i % 5) for i in range(60)] + [float("inf"), 1e6, None]
    df = spark.createDataFrame([(v, "t", None) for v in vals], "x double, t string, z double")
    got = result(tc.check_numeric(df, ["x", "t", "gone", "z"]))
    assert got[("numeric_type", "t")][:2] == (False, "error") and got[("numeric_type", "gone")][0] is False
    assert got[("infinite_values", "x")] == (False, "error", 1.0)
    assert got[("all_null", "z")] == (False, "error", 0.0)
    assert got[("iqr_share", "x")][0] is True


def test_categorical_schema_price_and_fx(spark):
    df = spark.createDataFrame([(f"u{i}", "a" if i else "b", -1.0 if i == 3 else 50.0, D0) for i in range(12)],
                               "u string, c string, price double, date date")
    got = result(tc.check_categorical(df, ["u", "c", "nope"]))
    assert got[("cardinality", "u")][:2] == (False, "warning") and got[("imbalance", "c")] == (False, "warning", 11.0)
    assert got[("category_column", "nope")][1] == "error"
    assert result(tc.check_negative_price(df))[("negative_price", "price")] == (False, "warning", -1.0)
    got = result(tc.check_schema(df, ["u", "zz"], {"u": T.StringType(), "price": T.LongType()}, {"price": (0.0, None)}))
    assert {k for k, v in got.items() if not v[0]} == {("required_column", "zz"), ("column_type", "price"), ("min_value", "price")}
    got = result(tc.check_fx(df, "price"))
    assert got[("fx_mean", "price")][:2] == (False, "warning") and got[("min_value", "price")][1] == "error"


def test_columns(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    got = result(tc.check_columns(df))
    assert got[("all_null_column", "b")][0] is False and got[("constant_column", "a")][0] is False
    dup = result(tc.check_columns(df.select("a", F.col("b").alias("a"))))
    assert dup == {("duplicate_columns", "table"): (False, "error", 1.0)}


def test_report_and_score(spark):
    rows = [("c", s, "x", "m", 0.0, 0.0, ok, "") for s, ok in (("info", True), ("warning", False), ("warning", False), ("error", False))]
    checks = driver_checks(spark, rows)
    r = report(union_checks([checks])).first()
    assert (r["total_checks"], r["passed_checks"], r["warning"], r["overall_status"], r["quality_score"]) == (4, 1, 2, "ERROR", 0.25)
    s = score_validation(checks).first()
    assert (s["errors"], s["warnings"], s["is_valid"]) == (1, 2, False) and s["score"] == pytest.approx(0.6)
    assert report(checks.limit(0)).first()["quality_score"] == 0.0


def test_custom_check_and_threshold(spark):
    def volume(df, cfg):
        return tc.check_min_rows(df, cfg)

    got = result(union_checks([volume(features(spark), CheckConfig(min_rows=50)), fc.check_leakage(features(spark), ["a"])]))
    assert got[("min_rows", "table")] == (False, "error", 30.0)


def test_undeclared_sources_are_told(spark):
    raw = spark.createDataFrame([("x", dt.date(2024, 1, 1), '{"v": 1}', dt.datetime(2024, 1, 1)), (None, dt.date(2024, 1, 1), None, None)],
                                "source string, date date, data string, ingested_at timestamp")
    got = {(r["check_name"], r["subject"]): r["passed"] for r in rc.validate_raw(raw, ["a"], "2024-01-02").collect()}
    assert got["source_declared", "x"] is False and got["source_declared", "(none)"] is False
    assert got["data_availability", "raw_data"] and not got["data_completeness", "a"] and ("source_declared", "a") not in got
    assert got["data_quality", "(none)"] is False and got["outlier_detection", "x"]
