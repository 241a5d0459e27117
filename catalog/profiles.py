"""Profiles and grouped aggregates (AGG, TOP) and metric events (MET)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import (DAILY_CTE, EVENTS_AS_OF, MARKET_COLS, MARKET_CTE, RATES_CTE, RAW_CTE, daily_prices, daily_rates,
                          market_sources, query, r4, r6, raw_events, rounded, s4, s6, table)
from tidemark.operators import metrics as met
from tidemark.operators import profile as prof
from tidemark.operators.align import align_sources
from tidemark.operators.checks.raw import rate_spikes

ITEM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RATE_COLS = ["official_rate", "parallel_rate"]


@query("count_per_source", f"WITH {RAW_CTE} SELECT source, COUNT(*) AS records FROM raw GROUP BY 1")
def _count(spark, sf):
    return prof.count_per_source(raw_events(spark, sf))


@query("latest_per_source", f"""WITH {RAW_CTE} SELECT source, MAX(date) AS latest_date, MAX(ingested_at) AS latest_ingest
  FROM raw GROUP BY 1""")
def _latest(spark, sf):
    return prof.latest_per_source(raw_events(spark, sf))


@query("source_coverage", f"""WITH {RAW_CTE} SELECT source, COUNT(*) AS records, MIN(date) AS earliest, MAX(date) AS latest
  FROM raw GROUP BY 1""")
def _coverage(spark, sf):
    return prof.source_coverage(raw_events(spark, sf))


@query("duplicate_keys", f"WITH {RAW_CTE} SELECT source, date, COUNT(*) AS records FROM raw GROUP BY 1, 2 HAVING COUNT(*) > 1")
def _dup_keys(spark, sf):
    return prof.duplicate_keys(raw_events(spark, sf))


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


@query("null_profile", f"WITH {MARKET_CTE} " + _union(
    f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS null_count, COUNT(*) AS total_count,
    {s6(f'(COUNT(*) - COUNT({c}))::DOUBLE / COUNT(*)')} AS null_ratio FROM market""" for c in MARKET_COLS))
def _nulls(spark, sf):
    out = prof.null_profile(align_sources(market_sources(spark, sf)), MARKET_COLS)
    return rounded(out, ["column", "null_count", "total_count"], six=["null_ratio"])


@query("completeness_score", f"""WITH {RATES_CTE} SELECT COUNT(*) AS rows, 2 * COUNT(*) - COUNT(official_rate) - COUNT(parallel_rate) AS null_cells,
  {s6('1 - (2 * COUNT(*) - COUNT(official_rate) - COUNT(parallel_rate))::DOUBLE / (4 * COUNT(*))')} AS completeness FROM rates""")
def _complete(spark, sf):
    out = prof.completeness_score(daily_rates(spark, sf).drop("__block"))
    return rounded(out, ["rows", "null_cells"], six=["completeness"])


_DUP = ["lang", "source", "text"]


@query("duplicate_rows", """WITH g AS (SELECT COUNT(*) AS n FROM documents GROUP BY lang, source, text)
  SELECT CAST(SUM(n) AS BIGINT) AS total_rows, CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows FROM g""")
def _dups(spark, sf):
    return prof.duplicate_rows(table(spark, sf, "documents"), _DUP)


@query("numeric_profile", _union(
    f"""SELECT '{c}' AS "column", COUNT({c}) AS "count", COUNT(*) - COUNT({c}) AS null_count, {s6(f'AVG({c})')} AS mean,
    {s6(f'STDDEV_SAMP({c})')} AS std, MIN({c}) AS min, MAX({c}) AS max FROM lineitem""" if c not in ("l_extendedprice", "l_quantity")
    else f"""SELECT '{c}' AS "column", COUNT({c}) AS "count", COUNT(*) - COUNT({c}) AS null_count, {s4(f'AVG({c})')} AS mean,
    {s4(f'STDDEV_SAMP({c})')} AS std, MIN({c}) AS min, MAX({c}) AS max FROM lineitem""" for c in ITEM_COLS))
def _numeric(spark, sf):
    out = prof.numeric_profile(table(spark, sf, "lineitem"), ITEM_COLS)
    big = F.col("column").isin("l_extendedprice", "l_quantity")
    return out.select("column", "count", "null_count", F.when(big, r4("mean")).otherwise(r6("mean")).alias("mean"),
                      F.when(big, r4("std")).otherwise(r6("std")).alias("std"), "min", "max")


def sql_fences(c: str, src: str) -> str:
    return (f"SELECT '{c}' AS \"column\", COUNT({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}")


_FENCES = "SELECT \"column\", n, q1, q3, " + s4("q1 - 1.5 * (q3 - q1)") + " AS lower, " + s4("q3 + 1.5 * (q3 - q1)") + " AS upper FROM f"


@query("iqr_fences", f"WITH f AS ({_union(sql_fences(c, 'lineitem') for c in ITEM_COLS)}) "
       + _FENCES.replace("q1, q3,", f"{s4('q1')} AS q1, {s4('q3')} AS q3,", 1))
def _iqr(spark, sf):
    return rounded(prof.iqr_fences(table(spark, sf, "lineitem"), ITEM_COLS), ["column", "n"], ["q1", "q3", "lower", "upper"])


# Quartiles per series, with nulls in the data.
@query("iqr_fences_by_series", f"""WITH {RATES_CTE}, f AS (SELECT series, COUNT(official_rate) AS n,
  quantile_cont(official_rate, 0.25) AS q1, quantile_cont(official_rate, 0.75) AS q3 FROM rates GROUP BY 1)
  SELECT series, 'official_rate' AS "column", n, {s4('q1')} AS q1, {s4('q3')} AS q3, {s4('q1 - 1.5 * (q3 - q1)')} AS lower,
  {s4('q3 + 1.5 * (q3 - q1)')} AS upper FROM f""")
def _iqr_series(spark, sf):
    out = prof.iqr_fences(daily_rates(spark, sf), ["official_rate"], key=["series"])
    return rounded(out, ["series", "column", "n"], ["q1", "q3", "lower", "upper"])


def sql_skew(c: str, src: str) -> str:
    m = f"(SELECT AVG({c}) FROM {src})"
    return (f"SELECT '{c}' AS \"column\", COUNT({c}) AS \"count\", "
            f"{s6(f'AVG(pow({c} - {m}, 3)) / NULLIF(pow(AVG(pow({c} - {m}, 2)), 1.5), 0)')} AS skewness FROM {src}")


@query("skewness_profile", _union(sql_skew(c, "lineitem") for c in ITEM_COLS))
def _skew(spark, sf):
    return rounded(prof.skewness_profile(table(spark, sf, "lineitem"), ITEM_COLS), ["column", "count"], six=["skewness"])


_CONST = {"c_custkey": "c_custkey", "c_acctbal": "c_acctbal", "flat": "1", "empty": "CAST(NULL AS DOUBLE)"}


@query("constant_columns", _union(
    f"""SELECT '{n}' AS "column", COUNT(*) AS rows, COUNT(*) - COUNT({e}) AS null_count, COUNT({e}) = 0 AS all_null,
    COUNT({e}) = 0 OR (COUNT({e}) = COUNT(*) AND COUNT(DISTINCT {e}) = 1) AS is_constant FROM customer""" for n, e in _CONST.items()))
def _constant(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("flat"),
                                             F.lit(None).cast("double").alias("empty"))
    return prof.constant_columns(df, list(_CONST))


def sql_corr(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"COVAR_SAMP({x}, {y}) / NULLIF(STDDEV_SAMP({x}) * STDDEV_SAMP({y}), 0)"


@query("correlation_pairs", f"WITH {MARKET_CTE} " + _union(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, {s6(sql_corr(a, b))} AS correlation FROM market"
    for a, b in combinations(MARKET_COLS, 2)))
def _corr(spark, sf):
    out = prof.correlation_pairs(align_sources(market_sources(spark, sf)), MARKET_COLS)
    return rounded(out, ["feature1", "feature2"], six=["correlation"])


CATS = ["p_brand", "p_type", "p_name"]
_CAT_CTE = "c AS (" + _union(f"SELECT '{c}' AS \"column\", {c} AS category, COUNT(*) AS n FROM part GROUP BY 2" for c in CATS) + ")"


@query("category_profile", f"""WITH {_CAT_CTE} SELECT "column", COUNT(*) AS unique_values, CAST(SUM(n) AS BIGINT) AS rows,
  CAST(COALESCE(SUM(n) FILTER (WHERE category IS NULL), 0) AS BIGINT) AS null_count, MAX(n) AS max_count, MIN(n) AS min_count,
  COUNT(*) > SUM(n) * 0.5 AS high_cardinality, COUNT(*) > 1 AND MAX(n) > MIN(n) * 10 AS imbalanced FROM c GROUP BY 1""")
def _category(spark, sf):
    return prof.category_profile(table(spark, sf, "part"), CATS)


@query("category_top5", f"""WITH {_CAT_CTE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC,
    category ASC NULLS LAST) AS rank FROM c) SELECT "column", category, n, rank FROM r WHERE rank <= 5""")
def _top(spark, sf):
    return prof.category_top(table(spark, sf, "part"), CATS).withColumn("rank", F.col("rank").cast("bigint"))


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


@query("table_counts", _union(f"SELECT '{t}' AS table_name, COUNT(*) AS rows FROM {t}" for t in TABLES))
def _tables(spark, sf):
    return prof.table_counts({t: table(spark, sf, t) for t in TABLES})


# Feature names are made from the event types, so that every family occurs.
_NAMES = {"click": "rate_lag_1", "error": "rate_rolling_mean_7", "purchase": "rate_rsi", "signup": "news_sentiment"}
_NAME_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " ELSE 'oil_price' END"


@query("feature_families", f"""WITH l AS (SELECT {_NAME_SQL} AS feature FROM events WHERE value IS NOT NULL),
  p AS (SELECT feature, COUNT(*) AS n FROM l GROUP BY 1)
  SELECT CASE WHEN feature LIKE '%lag%' THEN 'lag' WHEN feature LIKE '%rolling%' THEN 'rolling'
    WHEN feature LIKE '%rsi%' OR feature LIKE '%macd%' OR feature LIKE '%bb\\_%' ESCAPE '\\' THEN 'technical'
    WHEN feature LIKE '%sentiment%' THEN 'sentiment' ELSE 'base' END AS family, COUNT(*) AS features,
    CAST(SUM(n) AS BIGINT) AS "values" FROM p GROUP BY 1""")
def _families(spark, sf):
    ev = table(spark, sf, "events")
    name = F.lit("oil_price")
    for k, v in _NAMES.items():
        name = F.when(F.col("event_type") == k, v).otherwise(name)
    return prof.feature_families(ev.where(F.col("value").isNotNull()).select(name.alias("feature")))


@query("rate_spike_check", f"""WITH {RATES_CTE}, m AS (SELECT series, AVG(official_rate) AS mean FROM rates GROUP BY 1)
  SELECT series, {s4('mean')} AS mean, COUNT(*) FILTER (WHERE abs(official_rate - mean) / NULLIF(mean, 0) > 0.1) AS deviating_rows,
  COALESCE(BOOL_OR(abs(official_rate - mean) / NULLIF(mean, 0) > 0.1), FALSE) AS has_spike FROM rates JOIN m USING (series)
  GROUP BY series, mean""")
def _spike(spark, sf):
    out = rate_spikes(daily_rates(spark, sf), "official_rate", key=["series"])
    return rounded(out, ["series", "deviating_rows", "has_spike"], ["mean"])


# A column that is known on the first of each month only, next to the daily price.
@query("drop_sparse_columns", f"WITH {DAILY_CTE} SELECT series, date, price FROM daily")
def _sparse(spark, sf):
    df = daily_prices(spark, sf).drop("__block")
    df = df.withColumn("monthly_price", F.when(F.dayofmonth("date") == 1, F.col("price")))
    return prof.drop_sparse_columns(df, keep=["series", "date"])


# --- metric events ----------------------------------------------------------------------

def metric_events(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_type").alias("name"), "ts", "value", F.col("user_id").cast("string").alias("user"),
                     "event_id", F.when(F.get_json_object("props", "$.k").cast("int") < 5, "failure").otherwise("success")
                     .alias("status"))


MET_CTE = """m AS (SELECT event_type AS name, ts, value, CAST(user_id AS VARCHAR) AS "user", event_id,
  CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 5 THEN 'failure' ELSE 'success' END AS status FROM events)"""


@query("metric_counters", f"""WITH {MET_CTE} SELECT name, status, COUNT(*) AS events, {s4('SUM(value)')} AS total FROM m GROUP BY 1, 2""")
def _counters(spark, sf):
    return rounded(met.metric_counters(metric_events(spark, sf), ["status"]), ["name", "status", "events"], ["total"])


@query("metric_gauges", f"""WITH {MET_CTE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY name, "user" ORDER BY ts DESC, event_id DESC) AS rn
  FROM m) SELECT name, "user", value, ts FROM r WHERE rn = 1""")
def _gauges(spark, sf):
    return met.metric_gauges(metric_events(spark, sf), ["user"], tiebreak=["event_id"])


@query("metric_durations", f"""WITH {MET_CTE} SELECT name, COUNT(*) AS calls, {s6('AVG(value)')} AS mean, MAX(value) AS max,
  {s6("(COUNT(*) FILTER (WHERE status = 'success'))::DOUBLE / COUNT(*)")} AS success_ratio,
  {s6('quantile_cont(value, 0.95)')} AS p95 FROM m GROUP BY 1""")
def _durations(spark, sf):
    return rounded(met.metric_durations(metric_events(spark, sf), "status"), ["name", "calls", "max"],
                   six=["mean", "success_ratio", "p95"])


_B = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)


@query("metric_histogram", f"""WITH {MET_CTE} SELECT name, CASE {' '.join(f'WHEN value <= {b} THEN {b}::DOUBLE' for b in _B)}
  ELSE 'inf'::DOUBLE END AS le, COUNT(*) AS events FROM m WHERE value IS NOT NULL GROUP BY 1, 2""")
def _histogram(spark, sf):
    return met.metric_histogram(metric_events(spark, sf), _B)


@query("metric_summary", f"WITH {MET_CTE} SELECT name, COUNT(*) AS events FROM m GROUP BY 1")
def _summary(spark, sf):
    return met.metric_summary(metric_events(spark, sf))


@query("metric_retention", f"""WITH {MET_CTE} SELECT name, COUNT(*) FILTER (WHERE ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 72 HOUR) AS kept,
  COUNT(*) FILTER (WHERE NOT ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 72 HOUR) AS cleared FROM m GROUP BY 1""")
def _retention(spark, sf):
    return met.retention_counts(metric_events(spark, sf), 72, EVENTS_AS_OF)



# All columns of a wide frame, exact, null as a value.
_DISTINCT = {"lineitem": ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"],
             "orders": ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"], "documents": ["text", "lang", "source"]}


@query("distinct_counts", _union(f"SELECT '{t}' AS table_name, '{c}' AS \"column\", COUNT(DISTINCT {c}) + CAST(COUNT(*) > COUNT({c}) AS INTEGER) AS distinct_count FROM {t}"
                                 for t, cols in _DISTINCT.items() for c in cols))
def _distinct(spark, sf):
    out = [prof.distinct_counts(table(spark, sf, t), cols).withColumn("table_name", F.lit(t)) for t, cols in _DISTINCT.items()]
    return reduce(lambda a, b: a.unionByName(b), out)
