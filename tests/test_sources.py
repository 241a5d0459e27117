import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.functions.columns import columns_named, numeric_columns
from tidemark.functions.text import mask_sensitive, message_intent
from tidemark.sources import feature_store as fs
from tidemark.sources import raw_store as rs
from tidemark.sources.json_layouts import LAYOUTS, json_lines_reader, json_reader
from tidemark.sources.registry import Registry
from tidemark.sources.workdir import shared_folder, stage

D = dt.date
DOCS = {
    "cbn_rates": {"data": {"exchange_rates": [
        {"date": "2025-07-15", "currency": "USD", "central_rate": 1500.5, "official_rate": 1500, "parallel_rate": 1600.25},
        {"date": "2025-07-14", "currency": "USD", "official_rate": None}], "metadata": {"last_updated": "x"}}},
    "worldbank_reserves": {"data": [{"date": "2025-06", "reserves_usd": 3.5e10}], "metadata": {}},
    "dmo_debt": {"data": {"total_debt": {"as_at": "2025-07-15"}, "monthly_debt_data": [
        {"date": "2025-05", "total_debt": 1e14, "external_debt": 4e13}]}},
    "eia_brent": {"response": {"data": {"series": [{"end": "2025-07-15", "data": [["2025-07-15", 75.5], ["2025-07-14", "76"]]}]}}},
    "news_sentiment": {"articles": [{"publishedAt": "2025-07-15T08:00:00Z", "title": "t", "sentiment_score": 0.25,
                                     "sentiment_label": "positive", "relevance_score": 0.9}]},
}


@pytest.fixture
def json_files(tmp_path):
    for name, doc in DOCS.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "doc.json").write_text(json.dumps(doc, indent=2))
    return tmp_path


def test_five_json_layouts(spark, json_files):
    got = {n: json_reader(LAYOUTS[n])(spark, str(json_files / n)) for n in DOCS}
    assert rows(got["cbn_rates"].select("date", "official_rate", "parallel_rate"), "date") == [
        (D(2025, 7, 14), None, None), (D(2025, 7, 15), 1500.0, 1600.25)]
    assert rows(got["worldbank_reserves"], "date") == [(D(2025, 6, 1), 3.5e10)]
    assert rows(got["dmo_debt"].select("date", "total_debt", "domestic_debt"), "date") == [(D(2025, 5, 1), 1e14, None)]
    assert rows(got["eia_brent"], "date") == [(D(2025, 7, 14), 76.0), (D(2025, 7, 15), 75.5)]
    assert rows(got["news_sentiment"].select("date", "title", "sentiment_score"), "date") == [(D(2025, 7, 15), "t", 0.25)]


def test_json_lines_are_split_and_broken_lines_skipped(spark, json_files, tmp_path):
    for n in DOCS:
        (tmp_path / "lines" / n).mkdir(parents=True)
        (tmp_path / "lines" / n / "a.jsonl").write_text("\n".join([json.dumps(DOCS[n]), "", "{broken", "null", json.dumps(DOCS[n])]) + "\n")
        once = json_reader(LAYOUTS[n])(spark, str(json_files / n))
        twice = json_lines_reader(LAYOUTS[n])(spark, str(tmp_path / "lines" / n))
        order = twice.columns
        assert rows(twice, *order) == rows(once.unionByName(once), *order)
    record = '{"date": "2025-05", "total_debt": %d.0}\n'
    (tmp_path / "big.jsonl").write_text("".join(record % i for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        big = json_lines_reader(LAYOUTS["dmo_debt"], records=True)(spark, str(tmp_path / "big.jsonl"))
        assert big.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        assert big.agg(F.count("*"), F.sum("total_debt"), F.min("date")).first()[:] == (40_000, float(sum(range(40_000))), D(2025, 5, 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_reader_gets_the_date_range(spark, tmp_path):
    for day in ("2025-05-01", "2025-06-01", "2025-07-01"):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "a.jsonl").write_text(json.dumps({"date": day[:7], "total_debt": 1.0}) + "\n")
    registry = Registry().add("dmo_debt", json_lines_reader(LAYOUTS["dmo_debt"], records=True))
    got = registry.fetch(spark, "dmo_debt", str(tmp_path), "2025-06-01", "2025-06-15")
    assert [r["date"] for r in got.collect()] == [D(2025, 6, 1)]
    assert len(got.inputFiles()) == 3 and "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString()


def test_ingest_all_goes_on_after_a_failure(spark, json_files):
    registry = Registry()
    for n in DOCS:
        registry.add(n, lambda sp, path, n=n: json_reader(LAYOUTS[n])(sp, f"{path}/{n}"))
    registry.add("down", lambda sp, path: sp.read.parquet(f"{path}/nowhere"))
    target = f"{shared_folder(spark)}/raw"
    out = rs.ingest_all(spark, registry, str(json_files), target, "2025-05-01", "2025-07-31")
    got = {r["source"]: (r["records_ingested"], r["error"] is None) for r in out.collect()}
    assert got == {"cbn_rates": (2, True), "worldbank_reserves": (1, True), "dmo_debt": (1, True), "eia_brent": (2, True),
                   "news_sentiment": (1, True), "down": (0, False)}
    raw = rs.read_raw(spark, target)
    assert raw.count() == 7
    wide = rs.extract_wide(raw)
    r = wide.where("date = '2025-07-15'").first()
    assert (r["cbn_rates_official_rate"], r["eia_brent_price_usd"], r["news_sentiment_sentiment_label"]) == (1500.0, 75.5, "positive")
    typed = rs.extract_fields(raw)
    assert rows(typed["eia_brent"], "date") == [("all", D(2025, 7, 14), 76.0), ("all", D(2025, 7, 15), 75.5)]
    with pytest.raises(ValueError):
        registry.fetch(spark, "nope", "x", "2025-01-01", "2025-01-02")


def test_ingest_keeps_several_observations_a_day(spark):
    news = spark.createDataFrame([(D(2024, 1, 1), "a", 0.1), (D(2024, 1, 1), "b", 0.2), (D(2024, 1, 1), None, 0.3), (D(2024, 1, 1), None, 0.4)],
                                 "date date, title string, sentiment_score double")
    oil = spark.createDataFrame([(D(2024, 1, 1), "x", 1.0), (D(2024, 1, 1), "y", 2.0), (D(2024, 1, 1), "y", 3.0)], "date date, series string, price_usd double")
    registry = Registry().add("news_sentiment", lambda sp, path: news).add("eia_brent", lambda sp, path: oil).add("empty", lambda sp, path: oil.limit(0))
    target = f"{shared_folder(spark)}/raw"

    def run(hour):
        at = F.lit(dt.datetime(2024, 2, 1, hour))
        out = rs.ingest_all(spark, registry, "", target, "2024-01-01", "2024-01-31", at)
        return {r["source"]: (r["records_ingested"], r["records_stored"], r["error"]) for r in out.collect()}

    assert run(1) == {"news_sentiment": (4, 4, None), "eia_brent": (3, 2, None), "empty": (0, 0, None)}
    news = news.withColumn("sentiment_score", F.when(F.col("title") == "a", 0.9).otherwise(F.col("sentiment_score")))
    assert run(2) == {"news_sentiment": (4, 4, None), "eia_brent": (3, 2, None), "empty": (0, 0, None)}
    raw = rs.read_raw(spark, target)
    assert raw.count() == 6 and raw.where("data like '%0.9%'").count() == 1
    assert {r["series"] for r in raw.where("source = 'eia_brent'").collect()} == {"x", "y"}


def raw_row(source, day, data, hour):
    return (source, "all", D(2024, 1, day), data, dt.datetime(2024, 2, 1, hour))


def raw_frame(spark, *data):
    return spark.createDataFrame(list(data), rs.RAW)


@pytest.mark.parametrize("grain", ["day", "month", "year"])
def test_upsert_newest_wins_and_is_idempotent(spark, grain):
    path = f"{shared_folder(spark)}/raw"
    first = raw_frame(spark, raw_row("a", 1, "old", 1), raw_row("a", 2, "keep", 1), raw_row("b", 1, "other", 1))
    second = raw_frame(spark, raw_row("a", 1, "new", 3), raw_row("a", 1, "newer", 4), raw_row("a", 3, "added", 2),
                       raw_row("b", 1, "late copy", 0))
    rs.upsert_raw(first, path, grain)
    for _ in range(2):
        rs.upsert_raw(second, path, grain)
        got = rows(rs.read_raw(spark, path).select("source", "date", "data"), "source", "date")
        assert got == [("a", D(2024, 1, 1), "newer"), ("a", D(2024, 1, 2), "keep"), ("a", D(2024, 1, 3), "added"),
                       ("b", D(2024, 1, 1), "other")]
    assert rs.read_raw(spark, path, "2024-01-02", "2024-01-03", grain).count() == 2


def test_upsert_keeps_rows_without_a_date(spark):
    path = f"{shared_folder(spark)}/raw"
    undated = ("a", "all", None, "x", dt.datetime(2024, 2, 1))
    rs.upsert_raw(raw_frame(spark, undated, raw_row("a", 1, "dated", 1)), path)
    rs.upsert_raw(raw_frame(spark, ("a", "s2", None, "y", dt.datetime(2024, 2, 1))), path)
    assert sorted(r["data"] for r in rs.read_raw(spark, path).collect()) == ["dated", "x", "y"]


def test_period_filter_prunes_partitions(spark):
    path = f"{shared_folder(spark)}/raw"
    rs.upsert_raw(raw_frame(spark, raw_row("a", 1, "x", 1)), path)
    plan = rs.range_scan(rs.read_raw(spark, path, "2024-01-01", "2024-01-31"), "2024-01-01", "2024-01-31", ["a"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "part" in text.split("PartitionFilters")[1][:300]


def test_latest_wins_tie_and_recent_rows(spark):
    df = raw_frame(spark, raw_row("a", 1, "x", 1), raw_row("a", 1, "y", 1), *[raw_row("b", d, str(d), d) for d in range(1, 20)])
    assert [r["data"] for r in rs.latest_wins(df).where("source = 'a'").collect()] == ["y"]
    recent = rs.recent_rows(df, "2024-02-01 20:00:00", 7, 3)
    assert [(r["source"], r["data"]) for r in recent.orderBy("source", "rank").collect()] == [
        ("a", "y"), ("a", "x"), ("b", "19"), ("b", "18"), ("b", "17")]


def test_feature_store_round_trip(spark):
    df = spark.createDataFrame([("s", D(2024, 1, 1), 1.0, None, True), ("s", D(2024, 1, 2), 2.0, 3.0, None)],
                               "series string, date date, a double, b double, f boolean")
    packed = fs.pack_features(df, ["a", "b", "f"], "2.0")
    assert [(r["feature_count"], r["is_complete"]) for r in packed.orderBy("date").collect()] == [(2, False), (2, False)]
    path = f"{shared_folder(spark)}/features"
    fs.write_features(packed, path)
    store = spark.read.schema(fs.FEATURES).parquet(path)
    assert rows(fs.latest_features(store, 30, as_of="2024-01-05"), "date") == [
        ("s", D(2024, 1, 1), 1.0, None, 1.0), ("s", D(2024, 1, 2), 2.0, 3.0, None)]
    assert fs.latest_features(store, 1, as_of="2024-01-02", keys=["b", "zz"]).columns == ["series", "date", "b", "zz"]


def test_typed_sinks(spark):
    base = shared_folder(spark)
    models = spark.createDataFrame([("m", "1", 1, "linear", 0.8, dt.datetime(2024, 1, 1), True, {"depth": "6"})], fs.MODELS)
    fs.write_models(models, f"{base}/models")
    assert spark.read.schema(fs.MODELS).parquet(f"{base}/models").first()["hyperparameters"] == {"depth": "6"}
    p = spark.createDataFrame([("s", D(2024, 1, 1), 1, 5.0, 4.0, 6.0, 0.8, "m", ["x"], v) for v in ("1", "2")], fs.PREDICTIONS)
    fs.write_predictions(p, f"{base}/p")
    latest = fs.latest_predictions(spark.read.schema(fs.PREDICTIONS).parquet(f"{base}/p"))
    assert [r["model_version"] for r in latest.collect()] == ["2"]


def test_stage_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.rand(1))
    kept = stage(df)
    assert rows(kept, "id") == rows(kept, "id") and kept.count() == 10


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_mask(spark):
    df = spark.createDataFrame([("u", "p", ("n", "t"), {"API_Token": "a", "zone": "b"})],
                               "user string, db_password string, auth struct<name:string, secret_text:string>, labels map<string,string>")
    r = mask_sensitive(df).first()
    assert (r["user"], r["db_password"], r["auth"]["name"], r["auth"]["secret_text"]) == ("u", "***", "n", "***")
    assert r["labels"] == {"API_Token": "***", "zone": "b"}


def test_message_intent(spark):
    texts = ["Forecast for next WEEK", "prediction tomorrow", "give me a forecast", "WHY?", "help", "hello", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [(r["intent"], r["horizon"]) for r in message_intent(df, "t").orderBy("i").collect()] == [
        ("forecast", 5), ("forecast", 1), ("forecast", 1), ("explain", None), ("help", None), ("other", None), ("other", None)]


def test_column_selection(spark):
    df = spark.createDataFrame([], "date date, exchange_rate double, n int, price_label string, oil_Price float, sentiment_score double")
    assert numeric_columns(df) == ["exchange_rate", "n", "oil_Price", "sentiment_score"]
    assert columns_named(df, ("rate", "price")) == ["exchange_rate", "oil_Price"]


def test_sources_are_ingested_side_by_side(spark):
    """Two readers that wait for each other, one that fails, one that is empty."""
    import threading

    meet = threading.Barrier(2, timeout=60)

    def reader(name):
        def read(sp, path):
            meet.wait()
            return sp.createDataFrame([(D(2024, 1, d), name, float(d)) for d in range(1, 6)], "date date, what string, v double")
        return read

    def failing(sp, path):
        raise OSError("feed is down")

    registry = rs.Registry().add("a", reader("a")).add("b", reader("b")).add("bad", failing)
    registry.add("none", lambda sp, path: sp.createDataFrame([], "date date, v double"))
    target = f"{shared_folder(spark)}/raw"
    out = rs.ingest_all(spark, registry, "", target, "2024-01-01", "2024-01-31", F.lit(dt.datetime(2024, 2, 1)))
    assert [tuple(r) for r in out.collect()] == [("a", 5, 5, None), ("b", 5, 5, None), ("bad", 0, 0, "feed is down"), ("none", 0, 0, None)]
    got = rs.read_raw(spark, target).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"a": 5, "b": 5}


def test_removal_of_old_metrics(spark):
    from tidemark.sources.metric_store import read_metrics, remove_old_metrics, write_metrics

    start = dt.datetime(2024, 1, 1)
    data = [("m", start + dt.timedelta(hours=h), float(h)) for h in range(0, 120)] + [("m", None, -1.0)]
    df = spark.createDataFrame(data, "name string, ts timestamp, value double")
    path = f"{shared_folder(spark)}/metrics"
    write_metrics(df, path)
    assert remove_old_metrics(spark, path, df.schema, 24, "2024-01-04T06:00:00") == 55
    left = read_metrics(spark, path, df.schema)
    assert sorted(r["value"] for r in left.collect()) == [-1.0, *map(float, range(55, 120))]
    assert left.select("day").distinct().count() == 4
    assert remove_old_metrics(spark, path, df.schema, 24, "2024-01-04T06:00:00") == 0
    # the cut at the very end of a day leaves nothing of it
    assert remove_old_metrics(spark, path, df.schema, 0, "2024-01-03T23:00:00") == 17 and read_metrics(spark, path, df.schema).count() == 49
