"""Queries that run jobs: ingest, streams, sinks and the full run (SRC-5, SRC-11/12, STR, PIPE-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (DECLARED, EVENT_SOURCES, EVENTS_AS_OF, MARKET_CTE, ORDERS_AS_OF, RAW_CTE, daily_prices, query, r4,
                          r6, raw_events, s4, s6, table)
from catalog.checks import (COLS, RANGE_CFG, RAW_ALL, REPORT_SQL, FeatureSql, bound_sql, facts_cte, out_cte, raw_checks_sql,
                            raw_numbers, shown)
from catalog.features import END, FRAME_CTES, SPEC, START, last_known, raw_market
from catalog.profiles import MET_CTE, metric_events
from tidemark.operators.checks.raw import validate_raw
from tidemark.operators.forecast import naive_forecast
from tidemark.operators.metrics import metric_windows
from tidemark.plans.full_run import full_run
from tidemark.schemas import PREDICTIONS
from tidemark.sources.feature_store import write_predictions, write_report
from tidemark.sources.metric_store import read_metrics, remove_old_metrics, write_metrics
from tidemark.sources.raw_store import ingest_all, read_raw, upsert_raw
from tidemark.sources.registry import EXPECTED_RANGES, Registry
from tidemark.streaming import jobs
from tidemark.sources.workdir import shared_folder


def _failing(spark, path):
    raise OSError("feed is down")


@query("ingest_summary", """SELECT event_type AS source, COUNT(*) AS records_ingested, FALSE AS failed FROM events
  WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1 UNION ALL SELECT 'refund', 0, TRUE""")
def _ingest(spark, sf):
    registry = Registry()
    for s in EVENT_SOURCES:
        registry.add(s, lambda sp, path, s=s: raw_events(sp, path).where(F.col("source") == s).select("date", "value", "data"))
    registry.add("refund", _failing)
    out = ingest_all(spark, registry, sf, f"{shared_folder(spark)}/raw", "2024-01-01", "2024-01-31",
                     F.to_timestamp(F.lit(EVENTS_AS_OF)))
    return out.select("source", "records_ingested", F.col("error").isNotNull().alias("failed"))


@query("ingest_stored_rows", """SELECT event_type AS source, CAST(user_id AS VARCHAR) AS series, CAST(ts AS DATE) AS date, event_id,
  ROUND(value, 6) AS value FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'""")
def _stored(spark, sf):
    registry = Registry()
    for s in EVENT_SOURCES:
        registry.add(s, lambda sp, path, s=s: raw_events(sp, path).where(F.col("source") == s).select("date", "series", "event_id", "value"),
                     item=("event_id",))
    target = f"{shared_folder(spark)}/raw"
    ingest_all(spark, registry, sf, target, "2024-01-01", "2024-01-31", F.to_timestamp(F.lit(EVENTS_AS_OF)))
    doc = F.from_json("data", "event_id BIGINT, value DOUBLE")
    return read_raw(spark, target).select("source", "series", "date", doc["event_id"].alias("event_id"), F.round(doc["value"], 6).alias("value"))


# The first half of the events, then all from a day before its end: the second upsert meets rows that are there.
@query("raw_upsert_merge", f"""WITH {RAW_CTE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, series, date
    ORDER BY ingested_at DESC, data DESC) AS rn FROM raw) SELECT source, series, date, data, ingested_at FROM r WHERE rn = 1""")
def _upsert_merge(spark, sf):
    path, events = f"{shared_folder(spark)}/raw", _event_rows(table(spark, sf, "events"))
    upsert_raw(events.where("date < '2024-01-16'"), path)
    upsert_raw(events.where("date >= '2024-01-15'"), path)
    return read_raw(spark, path).select("source", "series", "date", "data", F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"))


def _event_rows(batch):
    return batch.select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("series"),
                        F.to_date("ts").alias("date"), F.col("props").alias("data"), F.col("ts").cast("timestamp").alias("ingested_at"))


def _event_stream(spark, sf):
    return jobs.file_stream(spark, sf, table(spark, sf, "events").schema, "events*.parquet")


# Several observations a day are told apart by a field of their payload.
@query("stream_ingest_upsert", f"""WITH {RAW_CTE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, series, date, json_extract_string(data, '$.k')
    ORDER BY ingested_at DESC, data DESC) AS rn FROM raw) SELECT source, series, date, data, ingested_at FROM r WHERE rn = 1""")
def _stream_ingest(spark, sf):
    work = shared_folder(spark)
    jobs.stream_ingest(_event_stream(spark, sf), _event_rows, f"{work}/raw", f"{work}/state",
                       items={s: ("k",) for s in EVENT_SOURCES})
    return read_raw(spark, f"{work}/raw").select("source", "series", "date", "data",
                                                 F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"))


@query("stream_quality", RAW_ALL + " SELECT * FROM checks")
def _stream_quality(spark, sf):
    work = shared_folder(spark)

    def rows(batch):
        k = F.get_json_object("props", "$.k").cast("int")
        doc = F.struct("value", k.alias("k"), (F.col("value") - 20).alias("delta"), F.col("event_type").alias("title"))
        return batch.select(F.col("event_type").alias("source"), F.to_date("ts").alias("date"), F.to_json(doc).alias("data"),
                            F.col("ts").alias("ingested_at"))

    jobs.stream_quality(_event_stream(spark, sf), rows, DECLARED, EVENTS_AS_OF, f"{work}/rows", f"{work}/checks", f"{work}/state", RANGE_CFG)
    return shown(spark.read.parquet(f"{work}/checks"))


_WINDOWS = f"""WITH {MET_CTE} SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end,
  name, COUNT(*) AS events, {s4('SUM(value)')} AS total FROM m GROUP BY 1, 2, 3"""


def _shown_windows(df):
    return df.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                     "name", "events", r4("total").alias("total"))


@query("metric_windows", _WINDOWS)
def _metric_windows(spark, sf):
    return _shown_windows(metric_windows(metric_events(spark, sf), "6 hours"))


# The stream closes a window once the watermark, two hours behind the newest event, has passed its end.
@query("stream_metric_windows", f"SELECT * FROM ({_WINDOWS}) WHERE window_end <= (SELECT MAX(ts) - INTERVAL 2 HOUR FROM events)")
def _stream_windows(spark, sf):
    work = shared_folder(spark)
    stream = _event_stream(spark, sf).select(F.col("event_type").alias("name"), "ts", "value")
    jobs.stream_metric_windows(stream, f"{work}/windows", f"{work}/state", "6 hours", "2 hours")
    return _shown_windows(spark.read.parquet(f"{work}/windows"))


@query("report_sink", RAW_ALL + " SELECT check_name, severity, subject, metric, passed FROM checks")
def _report_sink(spark, sf):
    path = f"{shared_folder(spark)}/report"
    checks = validate_raw(raw_numbers(spark, sf), DECLARED, EVENTS_AS_OF, RANGE_CFG)
    write_report(checks, path)
    return spark.read.schema(checks.schema).json(path).select(*COLS)


@query("predictions_sink", """WITH daily AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS price FROM orders GROUP BY 1, 2),
  m AS (SELECT series, MAX(date) AS prediction_date, arg_max(price, date) AS latest FROM daily GROUP BY 1),
  h AS (SELECT *, unnest([1, 3, 5]) AS horizon FROM m)
  SELECT series, prediction_date, horizon, round(latest + horizon * 0.5::DOUBLE, 2) AS point_forecast FROM h""")
def _predictions_sink(spark, sf):
    path = f"{shared_folder(spark)}/predictions"
    p = naive_forecast(daily_prices(spark, sf), "price", (1, 3, 5), key=["series"], order="date")
    p = p.withColumns({"model_name": F.lit("drift"), "features_used": F.array(F.lit("price"))})
    write_predictions(p, path)
    return spark.read.schema(PREDICTIONS).parquet(path).select("series", "prediction_date", "horizon", "point_forecast")


MARKET_FIELDS = {
    "cbn_rates": ("cbn", ("central_rate", "official_rate", "parallel_rate")),
    "worldbank_reserves": ("reserves", ("reserves_usd",)),
    "dmo_debt": ("debt", ("total_debt", "external_debt", "domestic_debt", "debt_servicing")),
    "eia_brent": ("oil", ("price_usd",)),
    "news_sentiment": ("news", ("sentiment_score", "relevance_score")),
}
RUN_COLS = ["exchange_rate", "rate_spread", "oil_price", "fx_reserves", "exchange_rate_rsi"]
_RAW_ROWS = " UNION ALL ".join(f"SELECT '{s}' AS source, date, 1 AS data, CAST(date AS TIMESTAMP) AS ingested_at FROM {t}"
                               for s, (t, _) in MARKET_FIELDS.items())
_NUMS = " UNION ALL ".join(f"SELECT '{s}' AS source, {f} AS v FROM {t} WHERE {f} IS NOT NULL" for s, (t, fs) in MARKET_FIELDS.items() for f in fs)
_RUN = FeatureSql(RUN_COLS, "feats")


def _stage_sql(stage: str) -> str:
    return f"SELECT '{stage}' AS stage, * FROM ({REPORT_SQL.replace('FROM checks', f'FROM {stage}_checks')})"


# Ingest, raw checks, features, feature checks and both scores, all over the five sources.
@query("full_run_report", f"""WITH {MARKET_CTE}, raw AS ({_RAW_ROWS}), {facts_cte(tuple(MARKET_FIELDS))}, nums AS ({_NUMS}),
  {out_cte(bound_sql(EXPECTED_RANGES, 0), bound_sql(EXPECTED_RANGES, 1))}, total AS (SELECT SUM(n) AS n FROM facts),
  raw_checks AS ({raw_checks_sql(ORDERS_AS_OF, EXPECTED_RANGES)}), {FRAME_CTES},
  feats AS (SELECT series, date, {', '.join(f'{last_known(c)} AS {c}' for c in RUN_COLS)} FROM fx), {_RUN.ctes},
  features_checks AS ({_RUN.all}), per AS ({_stage_sql('raw')} UNION ALL {_stage_sql('features')})
  SELECT * FROM per UNION ALL SELECT 'overall', {', '.join(f'CAST(SUM({c}) AS BIGINT)' for c in
    ('total_checks', 'passed_checks', 'failed_checks', 'info', 'warning', 'error', 'critical'))},
  {s6('(SELECT AVG(passed_checks::DOUBLE / total_checks) FROM per)')}, CASE WHEN SUM(critical) > 0 THEN 'CRITICAL' WHEN SUM(error) > 0 THEN 'ERROR'
    WHEN SUM(warning) > 0 THEN 'WARNING' ELSE 'PASSED' END FROM per""")
def _full_run(spark, sf):
    out = full_run(spark, raw_market(spark, sf), shared_folder(spark), tuple(MARKET_FIELDS), SPEC, start=START, end=END,
                   as_of=ORDERS_AS_OF, grain="year", check_cols=RUN_COLS)
    return out.withColumn("quality_score", r6("quality_score"))


# The metric table after old rows were removed: whole days, and a part of the day of the cut.
@query("metric_table_after_removal", "SELECT event_type AS name, ts, ROUND(value, 6) AS value FROM events WHERE ts > TIMESTAMP '2024-01-12 10:30:00'")
def _metric_removal(spark, sf):
    path = f"{shared_folder(spark)}/metrics"
    events = table(spark, sf, "events").select(F.col("event_type").alias("name"), "ts", "value")
    write_metrics(events, path)
    remove_old_metrics(spark, path, events.schema, 36, "2024-01-13T22:30:00")
    return read_metrics(spark, path, events.schema).select("name", "ts", F.round("value", 6).alias("value"))
