"""Raw table, sources and sinks (SRC, PRJ, JOIN, set operations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (EVENT_SOURCES, EVENTS_AS_OF, MARKET_COLS, MARKET_CTE, RATES_CTE, RAW_CTE,
                          daily_rates, market_sources, query, raw_events, s6, sql_rounded, rounded, table)
from tidemark.functions.text import mask_sensitive
from tidemark.operators.align import align_fanout, align_sources
from tidemark.operators.blocks import merge_blocks
from tidemark.operators.derived import cross_source_ratios, debt_ratio, drop_all_null_rows, rate_spread_premium
from tidemark.operators.profile import distinct_rows
from tidemark.sources.json_layouts import LAYOUTS, explode_documents, json_lines_reader
from tidemark.sources.raw_store import latest_wins, normalise_raw, range_scan, recent_rows
from tidemark.sources.registry import Registry
from tidemark.sources.workdir import shared_folder

SD = ["series", "date"]


@query("raw_range_scan", f"""WITH {RAW_CTE} SELECT source, date, data, ingested_at FROM raw
  WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""")
def _scan(spark, sf):
    return range_scan(raw_events(spark, sf), "2024-01-05", "2024-01-12").select("source", "date", "data", "ingested_at")


@query("source_fetch_range", f"""WITH {RAW_CTE} SELECT date, value, data FROM raw
  WHERE source = 'purchase' AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def _fetch(spark, sf):
    registry = Registry()
    for s in EVENT_SOURCES:
        registry.add(s, lambda sp, path, s=s: raw_events(sp, path).where(F.col("source") == s).select("date", "value", "data"))
    return registry.fetch(spark, "purchase", sf, "2024-01-10", "2024-01-20")


# Documents in the nested layout of the oil source: a list of [date, number] pairs, at most 64 to a document.
@query("json_source_explode", """SELECT event_type AS source, CAST(ts AS DATE) AS date, value AS price_usd FROM events""")
def _json(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.to_date("ts").alias("date"), "value",
        F.floor(F.col("event_id") / 64).alias("part"))
    pair = F.array(F.date_format("date", "yyyy-MM-dd"), F.col("value").cast("string"))
    lists = ev.groupBy("source", "part").agg(F.collect_list(pair).alias("data"))
    response = F.struct(F.struct(F.array(F.struct("data")).alias("series")).alias("data")).alias("response")
    docs = lists.select("source", F.to_json(F.struct(response)).alias("text"))
    return explode_documents(docs, "text", LAYOUTS["eia_brent"], keep=("source",))


@query("json_monthly_explode", """SELECT l_linestatus AS source, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS reserves_usd FROM lineitem GROUP BY 1, 2""")
def _json_monthly(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(
        F.col("l_linestatus").alias("source"), F.date_format("l_shipdate", "yyyy-MM").alias("date")).agg(
        F.sum(F.col("l_extendedprice").cast("DECIMAL(18,2)")).cast("double").alias("reserves_usd"))
    docs = m.select("source", F.to_json(F.struct(F.array(F.struct("date", "reserves_usd")).alias("data"))).alias("text"))
    return explode_documents(docs, "text", LAYOUTS["worldbank_reserves"], keep=("source",))


# All five layouts as JSON lines, a document per (series, year) or a record per line, written and read back by day ranges.
_FIVE = {"cbn_rates": ("cbn", ("central_rate", "official_rate", "parallel_rate")), "worldbank_reserves": ("reserves", ("reserves_usd",)),
         "dmo_debt": ("debt", ("total_debt", "external_debt", "domestic_debt", "debt_servicing")), "eia_brent": ("oil", ("price_usd",)),
         "news_sentiment": ("news", ("sentiment_score", "relevance_score"))}
_FIVE_SQL = " UNION ALL ".join(f"SELECT '{s}' AS source, date, '{f}' AS field, {f} AS value FROM {t}" for s, (t, fs) in _FIVE.items() for f in fs)


def _documents(df, source):
    """One document per series and year, in the layout of ``source``."""
    day = F.date_format("date", "yyyy-MM-dd")
    fields = [c for c in df.columns if c not in SD]
    record = {"eia_brent": lambda: F.array(day, F.col("price_usd").cast("string")),
              "news_sentiment": lambda: F.struct(F.concat(day, F.lit("T08:00:00Z")).alias("publishedAt"), *fields)}.get(
        source, lambda: F.struct(day.alias("date"), *fields))()
    lists = df.groupBy("series", F.year("date").alias("year")).agg(F.collect_list(record).alias("a"))
    a = F.col("a")
    doc = {"cbn_rates": F.struct(F.struct(a.alias("exchange_rates")).alias("data")), "worldbank_reserves": F.struct(a.alias("data")),
           "dmo_debt": F.struct(F.struct(a.alias("monthly_debt_data")).alias("data")),
           "eia_brent": F.struct(F.struct(F.struct(F.array(F.struct(a.alias("data"))).alias("series")).alias("data")).alias("response")),
           "news_sentiment": F.struct(a.alias("articles"))}[source]
    return lists.select(F.to_json(doc).alias("value"))


@query("json_lines_layouts", f"WITH {MARKET_CTE}, five AS ({_FIVE_SQL}) SELECT * FROM five WHERE date BETWEEN DATE '1995-03-01' AND DATE '2000-10-31'")
def _json_lines(spark, sf):
    folder, registry, out = shared_folder(spark), Registry(), None
    for name, df in market_sources(spark, sf).items():
        _documents(df, name).write.text(f"{folder}/{name}")
        reader = json_lines_reader(LAYOUTS[name])
        registry.add(name, lambda sp, path, start, end, n=name, reader=reader: reader(sp, f"{path}/{n}", start, end))
        rows = registry.fetch(spark, name, folder, "1995-03-01", "2000-10-31")
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in _FIVE[name][1]])).alias("c")
        one = rows.select(F.lit(name).alias("source"), "date", cells).select("source", "date", "c.field", "c.value")
        out = one if out is None else out.unionByName(one)
    return out


@query("json_record_lines", f"WITH {MARKET_CTE} SELECT date, total_debt, external_debt, domestic_debt, debt_servicing FROM debt WHERE date BETWEEN DATE '1996-02-01' AND DATE '1999-12-31'")
def _json_records(spark, sf):
    folder = f"{shared_folder(spark)}/debt"
    debt = market_sources(spark, sf)["dmo_debt"].drop("series").withColumn("date", F.date_format("date", "yyyy-MM"))
    debt.select(F.to_json(F.struct(*debt.columns)).alias("value"), F.concat("date", F.lit("-01")).alias("day")).repartition("day").write.partitionBy("day").text(folder)
    registry = Registry().add("dmo_debt", json_lines_reader(LAYOUTS["dmo_debt"], records=True))
    return registry.fetch(spark, "dmo_debt", folder, "1996-02-01", "1999-12-31")


@query("raw_normalise", """SELECT 'orders' AS source, o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,
  o_orderkey, o_totalprice, o_orderstatus, o_orderdate AS ingested_at FROM orders""")
def _normalise(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")
    raw = normalise_raw(orders, "orders", F.col("o_orderdate"), F.col("o_orderpriority"))
    doc = F.from_json("data", "o_orderkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING")
    return raw.select("source", "series", "date", doc.alias("d"), "ingested_at").select(
        "source", "series", "date", "d.*", "ingested_at")


@query("raw_latest_wins", f"""WITH {RAW_CTE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, date
    ORDER BY ingested_at DESC, event_id DESC) AS rn FROM raw)
  SELECT source, date, data, ingested_at, event_id FROM r WHERE rn = 1""")
def _latest(spark, sf):
    raw = raw_events(spark, sf).select("source", "date", "data", "ingested_at", "event_id")
    return latest_wins(raw, key=("source", "date"), tiebreak=("event_id",))


@query("recent_rows", f"""WITH {RAW_CTE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source
    ORDER BY ingested_at DESC, event_id DESC) AS rank FROM raw WHERE ingested_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY)
  SELECT source, event_id, ingested_at, rank FROM r WHERE rank <= 100""")
def _recent(spark, sf):
    out = recent_rows(raw_events(spark, sf), EVENTS_AS_OF, tiebreak=("event_id",))
    return out.select("source", "event_id", "ingested_at", F.col("rank").cast("bigint").alias("rank"))


@query("json_extract_fields", """SELECT event_type AS source, event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  CAST(NULL AS DOUBLE) AS absent FROM events""")
def _extract(spark, sf):
    raw = raw_events(spark, sf)
    return raw.select("source", "event_id", F.from_json("data", "k INT, absent DOUBLE").alias("d")).select(
        "source", "event_id", "d.*")


@query("rate_spread_premium", f"""WITH {RATES_CTE} SELECT series, date, official_rate AS exchange_rate, parallel_rate,
  parallel_rate - official_rate AS rate_spread, {s6('parallel_rate / NULLIF(official_rate, 0) - 1')} AS rate_premium,
  {s6('(parallel_rate - official_rate) / NULLIF(official_rate, 0) * 100')} AS rate_spread_pct FROM rates""")
def _spread(spark, sf):
    out = rate_spread_premium(daily_rates(spark, sf), "official_rate", "parallel_rate")
    return rounded(out, [*SD, "exchange_rate", "parallel_rate", "rate_spread"], six=["rate_premium", "rate_spread_pct"])


@query("debt_ratio", f"""WITH {MARKET_CTE} SELECT series, date, total_debt, external_debt, debt_servicing,
  {s6('external_debt / NULLIF(total_debt, 0)')} AS external_debt_ratio FROM debt""")
def _debt(spark, sf):
    out = debt_ratio(market_sources(spark, sf)["dmo_debt"], "total_debt", "external_debt", "debt_servicing")
    return rounded(out, [*SD, "total_debt", "external_debt", "debt_servicing"], six=["external_debt_ratio"])


@query("cross_source_ratios", f"""WITH {MARKET_CTE} SELECT {sql_rounded(SD, six={
    'exchange_rate_per_oil': 'cbn_rates_central_rate / NULLIF(eia_brent_price_usd, 0)',
    'oil_to_fx_ratio': 'eia_brent_price_usd / NULLIF(cbn_rates_central_rate, 0)',
    'reserves_to_debt_ratio': 'worldbank_reserves_reserves_usd / NULLIF(dmo_debt_total_debt, 0)'})},
    eia_brent_price_usd * cbn_rates_central_rate AS oil_price_ngn FROM market""")
def _ratios(spark, sf):
    from tidemark.operators.derived import base_features

    out = cross_source_ratios(base_features(align_sources(market_sources(spark, sf))))
    return rounded(out, [*SD, "oil_price_ngn"], six=["exchange_rate_per_oil", "oil_to_fx_ratio", "reserves_to_debt_ratio"])


@query("drop_all_null_rows", f"""WITH {RATES_CTE} SELECT series, date, official_rate, parallel_rate FROM rates
  WHERE official_rate IS NOT NULL OR parallel_rate IS NOT NULL""")
def _drop_null(spark, sf):
    return merge_blocks(drop_all_null_rows(daily_rates(spark, sf), ["official_rate", "parallel_rate"]))


@query("mask_sensitive", """SELECT c_custkey AS customer, '***' AS session_id, '***' AS login_password, c_name AS login_name,
  CASE WHEN c_mktsegment IS NULL THEN NULL ELSE '***' END AS labels_token, c_mktsegment AS labels_segment FROM customer""")
def _mask(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer"), F.col("c_name").alias("session_id"),
        F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("password")).alias("login"),
        F.create_map(F.lit("api_token"), "c_mktsegment", F.lit("segment"), "c_mktsegment").alias("labels"))
    m = mask_sensitive(c)
    return m.select("customer", "session_id", F.col("login.password").alias("login_password"),
                    F.col("login.name").alias("login_name"), F.col("labels")["api_token"].alias("labels_token"),
                    F.col("labels")["segment"].alias("labels_segment"))


@query("multi_source_align", f"""WITH {MARKET_CTE} SELECT series, date, {', '.join(MARKET_COLS)} FROM market""")
def _align(spark, sf):
    return align_sources(market_sources(spark, sf))


# Every event row of a user stays; the newest value of the user's day of each of three other sources is aligned to it.
@query("multi_source_align_fanout", f"""WITH {RAW_CTE},
  n AS (SELECT series, date, event_id, k FROM raw WHERE source IN ('click', 'view')),
  l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, series, date ORDER BY ingested_at DESC, value DESC) AS rn FROM raw
    WHERE source IN ('purchase', 'error', 'signup') AND value IS NOT NULL),
  p AS (SELECT series, date, MAX(value) FILTER (WHERE source = 'purchase') AS purchase_value, MAX(value) FILTER (WHERE source = 'error') AS error_value,
    MAX(value) FILTER (WHERE source = 'signup') AS signup_value FROM l WHERE rn = 1 GROUP BY 1, 2)
  SELECT series, date, event_id AS news_event_id, k AS news_k, purchase_value, error_value, signup_value FROM n FULL JOIN p USING (series, date)""")
def _fanout(spark, sf):
    raw = raw_events(spark, sf).withColumn("k", F.get_json_object("data", "$.k").cast("double"))
    news = raw.where(F.col("source").isin("click", "view")).select("series", "date", "event_id", "k")
    others = {s: raw.where(F.col("source") == s).select("series", "date", "value", "ingested_at") for s in ("purchase", "error", "signup")}
    return align_fanout(("news", news), others, how="last", by="ingested_at")


@query("multi_source_align_mean", f"""WITH {RAW_CTE} SELECT series, date, {', '.join(
    s6(f"CAST(SUM(CAST(value AS DECIMAL(18,2))) FILTER (WHERE source = '{s}') AS DOUBLE) / COUNT(value) FILTER (WHERE source = '{s}')") + f' AS {s}_value'
    for s in EVENT_SOURCES)} FROM raw GROUP BY 1, 2""")
def _align_mean(spark, sf):
    raw = raw_events(spark, sf)
    out = align_sources({s: raw.where(F.col("source") == s).select("series", "date", "value") for s in EVENT_SOURCES}, how="avg")
    return rounded(out, SD, six=[f"{s}_value" for s in EVENT_SOURCES])


@query("distinct_rows", f"""WITH {RAW_CTE} SELECT DISTINCT source, date, data FROM raw""")
def _distinct(spark, sf):
    return distinct_rows(raw_events(spark, sf), ["source", "date", "data"])

