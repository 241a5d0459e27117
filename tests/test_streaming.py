import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from tidemark.schemas import RAW
from tidemark.sources.raw_store import ingest_all, ingest_recent, latest_wins, read_raw
from tidemark.sources.registry import Registry
from tidemark.sources.workdir import shared_folder
from tidemark.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def write_batches(spark, folder, n=4):
    """Files that overlap: each repeats days of the one before with a newer payload."""
    for b in range(n):
        data = [("s", "all", dt.date(2024, 1, 1) + dt.timedelta(days=b * 3 + i), f"b{b}", T0 + dt.timedelta(hours=b)) for i in range(7)]
        spark.createDataFrame(data, RAW).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_and_replay_changes_nothing(spark):
    work = shared_folder(spark)
    write_batches(spark, f"{work}/in")
    want = rows(latest_wins(spark.read.parquet(f"{work}/in")), "date")

    def run(state):
        jobs.stream_ingest(jobs.file_stream(spark, f"{work}/in", RAW, files_per_batch=1), lambda b: b, f"{work}/raw", state)
        return rows(read_raw(spark, f"{work}/raw"), "date")

    assert run(f"{work}/state") == want and len(want) == 16
    # Nothing new: the same state does no work; a lost state replays every file.
    assert run(f"{work}/state") == want
    assert run(f"{work}/state2") == want


def test_repeats_are_dropped_in_the_stream(spark):
    work = shared_folder(spark)
    write_batches(spark, f"{work}/in", 2)
    stream = jobs.without_repeats(jobs.file_stream(spark, f"{work}/in", RAW).unionByName(
        jobs.file_stream(spark, f"{work}/in", RAW)), "ingested_at")
    jobs.stream_ingest(stream, lambda b: b, f"{work}/raw", f"{work}/state")
    got = {r["date"].day: r["data"] for r in read_raw(spark, f"{work}/raw").collect()}
    # A correction within the delay is no repeat: the newer payload wins.
    assert got == {d: "b0" if d < 4 else "b1" for d in range(1, 11)}
    jobs.run_available(stream, f"{work}/state2", lambda b, _: b.write.mode("append").parquet(f"{work}/seen"))
    assert spark.read.parquet(f"{work}/seen").count() == 14


def test_stream_quality_does_not_depend_on_batches(spark):
    work = shared_folder(spark)
    write_batches(spark, f"{work}/in", 4)
    found = []
    for n in (1, 2, 4):
        stream = jobs.file_stream(spark, f"{work}/in", RAW, files_per_batch=n)
        for state in ("s1", "s2"):  # the second run replays every batch
            jobs.stream_quality(stream, lambda b: b, ["s"], "2024-01-02", f"{work}/rows{n}", f"{work}/checks{n}", f"{work}/{state}{n}")
        found.append(sorted(map(str, spark.read.parquet(f"{work}/checks{n}").collect())))
    assert found[0] and found[0] == found[1] == found[2]


def test_stream_quality_sees_duplicates_of_other_batches(spark):
    work = shared_folder(spark)
    for i in range(2):
        spark.createDataFrame([("s", "a", dt.date(2024, 1, 1), "{}", T0)], RAW).coalesce(1).write.mode("append").parquet(f"{work}/in")
    jobs.stream_quality(jobs.file_stream(spark, f"{work}/in", RAW, files_per_batch=1), lambda b: b, ["s"], "2024-01-02",
                        f"{work}/rows", f"{work}/checks", f"{work}/state")
    got = spark.read.parquet(f"{work}/checks").where("check_name = 'data_consistency' AND NOT passed")
    assert got.count() == 1


def test_metric_windows_close_after_the_watermark(spark):
    work = shared_folder(spark)
    ev = spark.range(48).select(F.lit("m").alias("name"), (F.lit(T0) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"),
                                F.lit(1.0).alias("value"))
    ev.coalesce(1).write.parquet(f"{work}/in")
    jobs.stream_metric_windows(jobs.file_stream(spark, f"{work}/in", ev.schema), f"{work}/out", f"{work}/state", "6 hours", "2 hours")
    got = rows(spark.read.parquet(f"{work}/out"), "window_start")
    assert len(got) == 7 and all(r[3:] == (6, 6.0) for r in got)


def news(day, *titles, hour=0):
    return [("news_sentiment", "all", dt.date(2024, 1, day), f'{{"title": "{t}", "sentiment_score": {hour}}}', T0 + dt.timedelta(hours=hour)) for t in titles]


def test_stream_keeps_all_observations_of_a_day(spark):
    work = shared_folder(spark)
    registry = Registry().add("news_sentiment", lambda sp, path: sp.createDataFrame(
        [(dt.date(2024, 1, 3), t, 0.1) for t in "abcde"], "date date, title string, sentiment_score double"))
    done = ingest_all(spark, registry, "", f"{work}/raw", "2024-01-01", "2024-01-31", F.lit(T0)).first()
    assert tuple(done) == ("news_sentiment", 5, 5, None)
    # other days and a correction of the same day, without any word about items
    spark.createDataFrame(news(9, "x", "y") + news(3, "c", hour=5), RAW).coalesce(1).write.parquet(f"{work}/in")
    jobs.stream_ingest(jobs.file_stream(spark, f"{work}/in", RAW), lambda b: b, f"{work}/raw", f"{work}/state")
    stored = read_raw(spark, f"{work}/raw").select("date", F.get_json_object("data", "$.title").alias("t"), F.get_json_object("data", "$.sentiment_score").alias("s"))
    want = {(dt.date(2024, 1, 3), t, "5" if t == "c" else "0.1") for t in "abcde"} | {(dt.date(2024, 1, 9), t, "0") for t in "xy"}
    assert {tuple(r) for r in stored.collect()} == want and stored.count() == 7
    # the scheduled run meets its rows again: nothing changes but what it reads anew
    again = ingest_recent(spark, registry, "", f"{work}/raw", "2024-01-05", 7, F.lit(T0)).first()
    assert again["records_ingested"] == 5 and read_raw(spark, f"{work}/raw").count() == 7
    assert ingest_recent(spark, registry, "", f"{work}/raw", "2024-02-20", 7, F.lit(T0)).first()["records_ingested"] == 0


def test_upsert_reads_only_the_partitions_of_its_rows(spark, monkeypatch):
    from tidemark.sources import raw_store

    work = shared_folder(spark)
    rows = [("s", "all", dt.date(2024, m, 5), "{}", T0) for m in range(1, 13)]
    raw_store.upsert_raw(spark.createDataFrame(rows, RAW), f"{work}/raw")
    late = spark.createDataFrame([("s", "all", dt.date(2024, 1, 6), "{}", T0), ("s", "all", dt.date(2024, 12, 6), "{}", T0)], RAW)
    part = lambda: late.withColumn("part", F.trunc("date", "month"))
    table = raw_store._table(spark, f"{work}/raw")
    assert table.where(raw_store._touched(part())).count() == 2
    monkeypatch.setattr(raw_store, "MAX_PARTS", 1)
    assert table.where(raw_store._touched(part())).count() == 12
    monkeypatch.setattr(raw_store, "MAX_SOURCES", 0)
    assert raw_store._touched(part()) is None
    raw_store.upsert_raw(late, f"{work}/raw")
    assert read_raw(spark, f"{work}/raw").count() == 14


def test_stream_quality_reads_new_files_and_facts_only(spark):
    from tidemark.operators.checks.raw import validate_raw

    work = shared_folder(spark)
    data = [("s" if i % 3 else "t", "all", dt.date(2024, 1, 1 + i % 9), None if i == 4 else f'{{"v": {1000 if i == 7 else i % 5}}}', T0) for i in range(40)]
    files = [spark.createDataFrame(data[a : a + 20], RAW).coalesce(1) for a in (0, 20)]

    def run():
        jobs.stream_quality(jobs.file_stream(spark, f"{work}/in", RAW), lambda b: b, ["s", "u"], "2024-01-02", f"{work}/facts", f"{work}/checks", f"{work}/state")
        return sorted(map(str, spark.read.parquet(f"{work}/checks").collect()))

    files[0].write.mode("append").parquet(f"{work}/in")
    run()
    # the first file can be gone: what it held is in the facts
    first = spark.read.schema(RAW).parquet(f"{work}/in").cache()
    assert first.count() == 20
    both = sorted(map(str, validate_raw(first.unionByName(files[1]), ["s", "u"], "2024-01-02").collect()))
    files[1].write.mode("overwrite").parquet(f"{work}/in")
    assert run() == both
    assert spark.read.parquet(f"{work}/facts/days").count() < 40
