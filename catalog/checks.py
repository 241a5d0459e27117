"""Data-quality checks (VAL) and their roll-ups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.base import (DAILY_CTE, DECLARED, EVENTS_AS_OF, MARKET_CTE, ORDERS_AS_OF, RATES_CTE, RAW_CTE, daily_prices,
                          daily_rates, market_sources, query, r6, raw_events, s6, table)
from catalog.profiles import _union, sql_corr, sql_fences, sql_skew
from tidemark.operators.align import align_sources
from tidemark.operators.blocks import merge_blocks, one_per_day
from tidemark.operators.checks import features as fc
from tidemark.operators.checks import raw as rc
from tidemark.operators.checks import tables as tc
from tidemark.operators.checks.rows import CheckConfig, report, score_validation, union_checks
from tidemark.sources.workdir import stage

BY = {"key": ["series"], "order": "date"}
RATE_COLS = ["official_rate", "parallel_rate"]
COLS = ["check_name", "severity", "subject", "metric", "passed"]


def shown(checks: DataFrame) -> DataFrame:
    return checks.select(*COLS, r6("value").alias("value"), r6("threshold").alias("threshold"))


def row(src: str, name: str, passed: str, severity: str, subject: str, metric: str, value: str, threshold="NULL",
        where: str = "TRUE") -> str:
    """One check as a SELECT over the fact rows of ``src``."""
    return (f"SELECT '{name}' AS check_name, CASE WHEN COALESCE({passed}, FALSE) THEN 'info' ELSE {severity} END AS severity, "
            f"CAST({subject} AS VARCHAR) AS subject, '{metric}' AS metric, COALESCE({passed}, FALSE) AS passed, "
            f"{s6(f'CAST({value} AS DOUBLE)')} AS value, {s6(f'CAST({threshold} AS DOUBLE)')} AS threshold FROM {src} WHERE {where}")


W, E = "'warning'", "'error'"

# --- raw checks -------------------------------------------------------------------------

# The raw table made from orders: priority is the source, days have gaps and copies, open orders have no payload.
ORDER_SOURCES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "9-NONE")


def raw_orders(spark, sf):
    doc = F.to_json(F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderkey").alias("id")))
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("source"), F.lit("all").alias("series"), F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") != "P", doc).alias("data"), F.col("o_orderdate").alias("ingested_at"))


RAW_ORDERS = """raw AS (SELECT o_orderpriority AS source, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS data, o_orderdate AS ingested_at FROM orders)"""


def facts_cte(sources) -> str:
    names = ", ".join(f"'{s}'" for s in sources)
    return f"""days AS (SELECT source, date, COUNT(*) AS n, COUNT(*) - COUNT(data) AS nulls, MAX(ingested_at) AS li FROM raw GROUP BY 1, 2),
  gaps AS (SELECT *, date - LAG(date) OVER (PARTITION BY source ORDER BY date) AS gap FROM days),
  seen AS (SELECT source, SUM(n) AS n, SUM(nulls) AS nulls, MAX(date) AS ld, MAX(li) AS li, COUNT(*) FILTER (WHERE n > 1) AS dk,
    COUNT(*) FILTER (WHERE gap > 1) AS gaps FROM gaps GROUP BY 1),
  listed AS (SELECT unnest([{names}]) AS source),
  facts AS (SELECT source, COALESCE(n, 0) AS n, COALESCE(nulls, 0) AS nulls, ld, li, COALESCE(dk, 0) AS dk, COALESCE(gaps, 0) AS gaps
    FROM listed LEFT JOIN seen USING (source))"""


def hours(as_of: str, c: str) -> str:
    return f"((epoch_us(TIMESTAMP '{as_of}') - epoch_us({c})) / 3.6e9::DOUBLE)"


def completeness_sql(limit: int = 10) -> str:
    return row("facts", "data_completeness", f"n >= {limit}", W, "source", "record_count", "n", limit)


def freshness_sql(as_of: str) -> str:
    return row("facts", "data_freshness", f"{hours(as_of, 'li')} <= 48", W, "source", "hours_old", hours(as_of, "li"), 48)


CONSISTENCY_SQL = [row("facts", "data_consistency", "dk = 0", W, "source", "duplicate_keys", "dk", 0, "n > 0"),
                   row("facts", "data_continuity", "gaps = 0", W, "source", "date_gaps", "gaps", 0, "n > 1")]
PAYLOAD_SQL = row("facts", "data_quality", "nulls = 0", "CASE WHEN nulls::DOUBLE / n < 0.1 THEN 'warning' ELSE 'error' END",
                  "source", "null_ratio", "nulls::DOUBLE / n", 0.1, "n > 0")


@query("check_availability", "WITH f AS (SELECT COUNT(*) AS n FROM events) "
       + row("f", "data_availability", "n > 0", "'critical'", "'raw_data'", "record_count", "n", 1))
def _availability(spark, sf):
    return shown(rc.check_availability(raw_events(spark, sf)))


@query("check_completeness", f"WITH {RAW_CTE}, {facts_cte(DECLARED)} {completeness_sql()}")
def _completeness(spark, sf):
    return shown(rc.check_completeness(raw_events(spark, sf), DECLARED))


@query("check_freshness", f"WITH {RAW_CTE}, {facts_cte(DECLARED)} {freshness_sql(EVENTS_AS_OF)}")
def _freshness(spark, sf):
    return shown(rc.check_freshness(raw_events(spark, sf), DECLARED, EVENTS_AS_OF))


@query("check_consistency", f"WITH {RAW_ORDERS}, {facts_cte(ORDER_SOURCES)} " + _union(CONSISTENCY_SQL))
def _consistency(spark, sf):
    return shown(rc.check_consistency(raw_orders(spark, sf), ORDER_SOURCES))


@query("check_null_payload", f"WITH {RAW_ORDERS}, {facts_cte(ORDER_SOURCES)} {PAYLOAD_SQL}")
def _payload(spark, sf):
    return shown(rc.check_null_payload(raw_orders(spark, sf), ORDER_SOURCES))


RANGES = {"click": (0.0, 200.0), "error": (0.0, 99.0), "purchase": (-1.0, 1.0), "view": (0.0, 1e9)}
RANGE_CFG = CheckConfig(ranges=RANGES)


def raw_numbers(spark, sf):
    """Events whose payload holds two numbers and a text."""
    k = F.get_json_object("data", "$.k").cast("int")
    raw = raw_events(spark, sf)
    doc = F.struct("value", k.alias("k"), (F.col("value") - 20).alias("delta"), F.col("source").alias("title"),
                   F.when(k >= 2, "NGN").alias("currency"))
    return raw.withColumn("data", F.to_json(doc))




def bound_sql(ranges, i: int) -> str:
    return "CASE source " + " ".join(f"WHEN '{s}' THEN {b[i]}::DOUBLE" for s, b in ranges.items()) + " END"


_LOW, _HIGH = bound_sql(RANGES, 0), bound_sql(RANGES, 1)


def out_cte(low: str, high: str) -> str:
    """Outliers and values out of range per source, from (source, v) rows in ``nums``."""
    return f"""stats AS (SELECT source, AVG(v) AS mean, STDDEV_POP(v) AS std FROM nums GROUP BY 1),
  out AS (SELECT source, COUNT(*) FILTER (WHERE abs((v - mean) / NULLIF(std, 0)) > 3) AS outliers,
    COUNT(*) FILTER (WHERE v < {low} OR v > {high}) AS out_of_range FROM nums JOIN stats USING (source) GROUP BY 1)"""


NUMBERS_CTE = ("nums AS (SELECT source, value AS v FROM raw UNION ALL SELECT source, k FROM raw UNION ALL SELECT source, value - 20 FROM raw), "
               + out_cte(_LOW, _HIGH))
OUTLIER_SQL = row("out", "outlier_detection", "outliers = 0", W, "source", "outlier_count", "outliers", 3)


def range_sql(ranges) -> str:
    return row("out", "range_validation", "out_of_range = 0", E, "source", "out_of_range_count", "out_of_range", 0,
               "source IN (" + ", ".join(f"'{s}'" for s in ranges) + ")")


RANGE_SQL = range_sql(RANGES)


@query("check_raw_outliers", f"WITH {RAW_CTE}, {NUMBERS_CTE} {OUTLIER_SQL}")
def _raw_outliers(spark, sf):
    return shown(rc.check_raw_outliers(raw_numbers(spark, sf), DECLARED, RANGE_CFG))


@query("check_ranges", f"WITH {RAW_CTE}, {NUMBERS_CTE} {RANGE_SQL}")
def _ranges(spark, sf):
    return shown(rc.check_ranges(raw_numbers(spark, sf), DECLARED, RANGE_CFG))


@query("top_outlier_values", f"""WITH {RAW_CTE}, {NUMBERS_CTE}, z AS (SELECT source, v AS value, (v - mean) / NULLIF(std, 0) AS z
    FROM nums JOIN stats USING (source)), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY abs(z) DESC, value) AS rank
    FROM z WHERE abs(z) > 3) SELECT source, rank, value, {s6('z')} AS z FROM r WHERE rank <= 10""")
def _outlier_values(spark, sf):
    out = rc.outlier_values(raw_numbers(spark, sf), DECLARED)
    return out.select("source", F.col("rank").cast("bigint").alias("rank"), "value", r6("z").alias("z"))


def raw_checks_sql(as_of: str, ranges) -> str:
    return _union([row("total", "data_availability", "n > 0", "'critical'", "'raw_data'", "record_count", "n", 1), completeness_sql(),
                   freshness_sql(as_of), *CONSISTENCY_SQL, PAYLOAD_SQL, OUTLIER_SQL, range_sql(ranges)])


RAW_ALL = f"""WITH {RAW_CTE}, {facts_cte(DECLARED)}, {NUMBERS_CTE}, total AS (SELECT SUM(n) AS n FROM facts),
  checks AS ({raw_checks_sql(EVENTS_AS_OF, RANGES)})"""


@query("raw_validation", RAW_ALL + " SELECT * FROM checks")
def _raw_validation(spark, sf):
    return shown(rc.validate_raw(raw_numbers(spark, sf), DECLARED, EVENTS_AS_OF, RANGE_CFG))


# The raw checks of the orders with their messages and evidence, one row per date, gap or value named in the details.
MESSAGES = {"data_completeness": ("enough records in ", "too few records in "), "data_freshness": ("fresh data from ", "stale data from "),
            "data_consistency": ("no duplicate dates in ", "duplicate dates in "), "data_continuity": ("no date gaps in ", "date gaps in "),
            "data_quality": ("no null data in ", "null data in "), "outlier_detection": ("no outliers in ", "outliers in "),
            "range_validation": ("all values in range in ", "values out of range in ")}
_MESSAGE_SQL = "CASE check_name WHEN 'data_availability' THEN 'data available' " + " ".join(
    f"WHEN '{c}' THEN CASE WHEN passed THEN '{good}' ELSE '{bad}' END || subject" for c, (good, bad) in MESSAGES.items()) + " END"
ORDER_RANGES = {"1-URGENT": (1000.0, 250000.0), "3-MEDIUM": (0.0, 1e9), "5-LOW": (2000.0, 400000.0)}
ORDER_CFG = CheckConfig(ranges=ORDER_RANGES, z_limit=2.0)


def shown_evidence(checks: DataFrame) -> DataFrame:
    named = checks.select("check_name", "subject", "passed", "message", F.explode_outer("details").alias("key", "entry"))
    items = named.select("check_name", "subject", "passed", "message", "key", F.posexplode(F.split(F.coalesce("entry", F.lit("")), ",")).alias("pos", "item"))
    number = F.col("item").try_cast("double")
    return items.select("check_name", "subject", "passed", "message", "key", F.col("pos").cast("bigint").alias("pos"),
                        F.when(number.isNull(), F.nullif("item", F.lit(""))).alias("text"), r6(number).alias("number"))


@query("raw_validation_evidence", f"""WITH {RAW_ORDERS}, {facts_cte(ORDER_SOURCES)}, total AS (SELECT SUM(n) AS n FROM facts),
  nums AS (SELECT source, data AS v FROM raw WHERE data IS NOT NULL
    UNION ALL SELECT o_orderpriority, CAST(o_orderkey AS DOUBLE) FROM orders WHERE o_orderstatus <> 'P'),
  {out_cte(bound_sql(ORDER_RANGES, 0), bound_sql(ORDER_RANGES, 1)).replace('> 3', '> 2')},
  checks AS ({_union([row("total", "data_availability", "n > 0", "'critical'", "'raw_data'", "record_count", "n", 1), completeness_sql(),
    freshness_sql(ORDERS_AS_OF), *CONSISTENCY_SQL, PAYLOAD_SQL, OUTLIER_SQL,
    row("out", "range_validation", "out_of_range = 0", E, "source", "out_of_range_count", "out_of_range", 0,
        "source IN (" + ", ".join(f"'{k}'" for k in ORDER_RANGES) + ")")])}),
  named AS (SELECT DISTINCT source, v, abs((v - mean) / NULLIF(std, 0)) AS far FROM nums JOIN stats USING (source)),
  evidence AS (
    SELECT 'data_freshness' AS check_name, source, 'latest_date' AS key, 0 AS pos, CAST(ld AS VARCHAR) AS text, NULL::DOUBLE AS number FROM facts
    UNION ALL SELECT 'data_freshness', source, 'latest_ingest', 0, CAST(CAST(li AS TIMESTAMP) AS VARCHAR), NULL FROM facts
    UNION ALL SELECT 'data_consistency', source, 'dates', ROW_NUMBER() OVER (PARTITION BY source ORDER BY date) - 1, CAST(date AS VARCHAR), NULL FROM days WHERE n > 1
    UNION ALL SELECT 'data_continuity', source, 'missing', ROW_NUMBER() OVER (PARTITION BY source ORDER BY date) - 1,
      CAST(CAST(date - CAST(gap AS INTEGER) + 1 AS DATE) AS VARCHAR) || '..' || CAST(CAST(date - 1 AS DATE) AS VARCHAR), NULL FROM gaps WHERE gap > 1
    UNION ALL SELECT 'outlier_detection', source, 'values', ROW_NUMBER() OVER (PARTITION BY source ORDER BY far DESC, v) - 1, NULL, {s6('v')} FROM named WHERE far > 2
    UNION ALL SELECT 'range_validation', source, 'values', ROW_NUMBER() OVER (PARTITION BY source ORDER BY v) - 1, NULL, {s6('v')} FROM named
      WHERE v < {bound_sql(ORDER_RANGES, 0)} OR v > {bound_sql(ORDER_RANGES, 1)}),
  keys AS (SELECT unnest(['data_freshness', 'data_freshness', 'data_consistency', 'data_continuity', 'outlier_detection', 'range_validation']) AS check_name,
    unnest(['latest_date', 'latest_ingest', 'dates', 'missing', 'values', 'values']) AS key)
  SELECT c.check_name, c.subject, c.passed, {_MESSAGE_SQL.replace('check_name', 'c.check_name').replace('subject', 'c.subject')} AS message, k.key,
    CAST(COALESCE(e.pos, 0) AS BIGINT) AS pos, e.text, e.number
  FROM checks c LEFT JOIN keys k USING (check_name) LEFT JOIN evidence e ON e.check_name = c.check_name AND e.source = c.subject AND e.key = k.key
    AND e.pos < CASE c.check_name WHEN 'range_validation' THEN 5 ELSE 10 END""")
def _raw_evidence(spark, sf):
    return shown_evidence(rc.validate_raw(raw_orders(spark, sf), ORDER_SOURCES, ORDERS_AS_OF, ORDER_CFG))


REPORT_COLS = """COUNT(*) AS total_checks, COUNT(*) FILTER (WHERE passed) AS passed_checks, COUNT(*) FILTER (WHERE NOT passed) AS failed_checks,
  COUNT(*) FILTER (WHERE severity = 'info') AS info, COUNT(*) FILTER (WHERE severity = 'warning') AS warning,
  COUNT(*) FILTER (WHERE severity = 'error') AS error, COUNT(*) FILTER (WHERE severity = 'critical') AS critical"""
REPORT_SQL = f"""SELECT {REPORT_COLS}, {s6('(COUNT(*) FILTER (WHERE passed))::DOUBLE / COUNT(*)')} AS quality_score,
  CASE WHEN BOOL_OR(severity = 'critical') THEN 'CRITICAL' WHEN BOOL_OR(severity = 'error') THEN 'ERROR'
    WHEN BOOL_OR(severity = 'warning') THEN 'WARNING' ELSE 'PASSED' END AS overall_status FROM checks"""


def shown_report(df: DataFrame) -> DataFrame:
    return df.withColumn("quality_score", r6("quality_score"))


@query("validation_report", f"{RAW_ALL} {REPORT_SQL}")
def _report(spark, sf):
    return shown_report(report(rc.validate_raw(raw_numbers(spark, sf), DECLARED, EVENTS_AS_OF, RANGE_CFG)))


@query("score_validation", f"""{RAW_ALL}, f AS (SELECT COUNT(*) FILTER (WHERE NOT passed AND severity IN ('error', 'critical')) AS errors,
  COUNT(*) FILTER (WHERE NOT passed AND severity = 'warning') AS warnings FROM checks)
  SELECT errors, warnings, {s6('greatest(0::DOUBLE, least(1::DOUBLE, 1 - 0.2::DOUBLE * errors - 0.1::DOUBLE * warnings))')} AS score,
  errors = 0 AS is_valid FROM f""")
def _score(spark, sf):
    checks = rc.validate_raw(raw_numbers(spark, sf), DECLARED, EVENTS_AS_OF, RANGE_CFG)
    return score_validation(checks).withColumn("score", r6("score"))


REQUIRED = {"click": ("k", "value"), "error": ("k", "currency"), "purchase": ("title", "value"), "view": ("k", "absent"),
            "signup": ()}
RECENT_CFG = CheckConfig(required=REQUIRED)
RECENT_CTE = f"""recent AS (SELECT * FROM raw WHERE ingested_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY),
  rm AS (SELECT AVG(NULLIF(value, 0)) AS mean FROM recent WHERE source IN ('click', 'error')),
  rmm AS (SELECT source, AVG(NULLIF(value, 0)) AS mean FROM recent WHERE source IN ('click', 'error') GROUP BY 1),
  rs AS (SELECT source, COUNT(*) AS n, BOOL_OR(k < 2) AS no_currency,
    COALESCE(BOOL_OR(abs(NULLIF(value, 0) - mean) / NULLIF(mean, 0) > 0.1), FALSE) AS spike,
    BOOL_OR(source = 'view' AND value - 20 < 0) AS negative FROM recent LEFT JOIN rmm USING (source) GROUP BY 1),
  recent_facts AS (SELECT l.source, COALESCE(n, 0) AS n, COALESCE(spike, FALSE) AS spike, COALESCE(negative, FALSE) AS negative,
    CASE WHEN n IS NULL THEN '' WHEN l.source = 'error' AND no_currency THEN 'currency' WHEN l.source = 'view' THEN 'absent' ELSE '' END AS missing
    FROM (SELECT unnest([{', '.join(f"'{s}'" for s in DECLARED)}]) AS source) l LEFT JOIN rs USING (source))"""


def recent(spark, sf):
    return rc.recent_facts(raw_numbers(spark, sf), DECLARED, EVENTS_AS_OF, "value", "delta", ("click", "error"), ("view",), RECENT_CFG)


@query("check_required_fields", f"WITH {RAW_CTE}, {RECENT_CTE} " + row(
    "recent_facts", "required_fields", "missing = ''", E, "source", "missing_fields", "CASE WHEN missing = '' THEN 0 ELSE 1 END", 0,
    "n > 0"))
def _required(spark, sf):
    return shown(rc.required_field_checks(recent(spark, sf)))


@query("ingest_quality_status", f"""WITH {RAW_CTE}, {RECENT_CTE} SELECT source, n,
  CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS data_availability,
  CASE WHEN n > 0 THEN CASE WHEN missing = '' THEN 'pass' ELSE 'fail' END END AS completeness,
  CASE WHEN n > 0 THEN CASE WHEN spike OR negative THEN 'warning' ELSE 'pass' END END AS consistency,
  CASE WHEN n = 0 OR missing <> '' THEN 'fail' WHEN spike OR negative THEN 'warning' ELSE 'pass' END AS overall_status
  FROM recent_facts""")
def _ingest_quality(spark, sf):
    return rc.ingest_quality(recent(spark, sf))


@query("source_health", f"""WITH {RAW_CTE}, {facts_cte(DECLARED)} SELECT source, li AS last_ingestion, CAST(n AS BIGINT) AS records,
  CASE WHEN n = 0 THEN 'error' WHEN {hours('2024-02-01', 'li')} > 48 THEN 'degraded' ELSE 'ok' END AS health FROM facts""")
def _health(spark, sf):
    return rc.source_health(raw_events(spark, sf), DECLARED, "2024-02-01")


# --- feature checks ---------------------------------------------------------------------

FEATS = ["cbn_rates_central_rate", "cbn_rates_parallel_rate", "eia_brent_price_usd", "worldbank_reserves_reserves_usd",
         "news_sentiment_sentiment_score", "flat"]
FEATS_CTE = f"{MARKET_CTE}, feats AS (SELECT *, 1::DOUBLE AS flat FROM market)"


def feats(spark, sf, staged: bool = False):
    """Aligned sources plus a constant column; ``staged`` for checks that scan the frame several times."""
    df = align_sources(market_sources(spark, sf)).select("series", "date", *FEATS[:-1]).withColumn("flat", F.lit(1.0))
    return one_per_day(stage(df) if staged else df)


def stab_cte(cols, src: str) -> str:
    prior = "OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    lags = ", ".join(f"LAST_VALUE({c} IGNORE NULLS) {prior} AS p_{c}" for c in cols)
    return (f"pv AS (SELECT *, {lags} FROM {src}), st AS (" + _union(
        f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE abs(({c} - p_{c}) / NULLIF(p_{c}, 0)) > 0.5) AS ex FROM pv" for c in cols) + ")")


class FeatureSql:
    """CTEs and check rows of the feature checks on ``cols`` of the CTE ``src``."""

    def __init__(self, cols, src: str):
        def ratio(c):
            return f"(COUNT(*) - COUNT({c}))::DOUBLE / COUNT(*)"

        def beyond(c):
            fence = f"FROM q WHERE \"column\" = '{c}'"
            return f"{c} < (SELECT q1 - 1.5 * (q3 - q1) {fence}) OR {c} > (SELECT q3 + 1.5 * (q3 - q1) {fence})"

        self.nulls = [row(src, "feature_completeness", f"NOT ({ratio(c)} > 0.1)", W, f"'{c}'", "null_ratio", ratio(c), 0.1) for c in cols]
        self.dist_cte = ("sk AS (" + _union(sql_skew(c, src) for c in cols) + "), lim AS (" + _union(
            f"SELECT '{c}' AS \"column\", MIN({c}) = MAX({c}) AS same FROM {src}" for c in cols)
            + '), dist AS (SELECT * FROM sk JOIN lim USING ("column"))')
        self.dist = row("dist", "feature_distribution", "NOT same", W, '"column"', "skewness", "CASE WHEN NOT same THEN skewness END", 2,
                        '"count" > 10')
        self.corr_cte = ("cr AS (" + _union(f"SELECT {sql_corr(a, b)} AS r FROM {src}" for a, b in combinations(cols, 2))
                         + "), cc AS (SELECT COUNT(*) FILTER (WHERE abs(r) > 0.95) AS n FROM cr)")
        self.corr = row("cc", "feature_correlation", "n = 0", W, "'features'", "high_correlations", "n", 0.95)
        self.stab_cte = stab_cte(cols, src)
        self.stab = row("st", "feature_stability", "ex = 0", W, '"column"', "extreme_changes", "ex", 50)
        self.iqr_cte = "q AS (" + _union(sql_fences(c, src) for c in cols) + "), io AS (" + _union(
            f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {beyond(c)}) AS o, COUNT({c}) AS n FROM {src}" for c in cols) + ")"
        self.iqr = row("io", "feature_outliers", "o::DOUBLE / n < 0.05", "'info'", '"column"', "outlier_ratio", "o::DOUBLE / n", 0.05, "n > 10")
        self.ctes = ", ".join([self.dist_cte, self.corr_cte, self.stab_cte, self.iqr_cte])
        self.all = _union([*self.nulls, self.dist, self.corr, self.stab, self.iqr])


FS = FeatureSql(FEATS, "feats")


@query("check_feature_nulls", f"WITH {FEATS_CTE} " + _union(FS.nulls))
def _feature_nulls(spark, sf):
    return shown(fc.check_feature_nulls(feats(spark, sf), FEATS))


@query("check_distribution", f"WITH {FEATS_CTE}, {FS.dist_cte} {FS.dist}")
def _distribution(spark, sf):
    return shown(fc.check_distribution(feats(spark, sf), FEATS))


@query("check_correlation", f"WITH {FEATS_CTE}, {FS.corr_cte} {FS.corr}")
def _correlation(spark, sf):
    return shown(fc.check_correlation(feats(spark, sf), FEATS))


@query("check_stability", f"WITH {FEATS_CTE}, {FS.stab_cte} {FS.stab}")
def _stability(spark, sf):
    return shown(fc.check_stability(feats(spark, sf), FEATS, **BY))


@query("check_iqr_outliers", f"WITH {FEATS_CTE}, {FS.iqr_cte} {FS.iqr}")
def _iqr(spark, sf):
    return shown(fc.check_iqr_outliers(feats(spark, sf, staged=True), FEATS))


FEATURE_ALL = f"WITH {FEATS_CTE}, {FS.ctes}, checks AS ({FS.all})"


@query("feature_validation", FEATURE_ALL + " SELECT * FROM checks")
def _feature_validation(spark, sf):
    return shown(fc.validate_features(feats(spark, sf, staged=True), FEATS, **BY))


@query("all_checks", f"WITH c1 AS ({RAW_ALL} SELECT * FROM checks), c2 AS ({FEATURE_ALL} SELECT * FROM checks) "
       "SELECT * FROM c1 UNION ALL SELECT * FROM c2")
def _all_checks(spark, sf):
    raw = rc.validate_raw(raw_numbers(spark, sf), DECLARED, EVENTS_AS_OF, RANGE_CFG)
    return shown(union_checks([raw, fc.validate_features(feats(spark, sf, staged=True), FEATS, **BY)]))


# --- rule sets --------------------------------------------------------------------------

@query("check_min_rows", "WITH f AS (SELECT COUNT(*) AS n FROM orders) " + _union([
    row("f", "not_empty", "n > 0", E, "'table'", "rows", "n", 1), row("f", "min_rows", "n >= 10", E, "'table'", "rows", "n", 10)]))
def _min_rows(spark, sf):
    return shown(tc.check_min_rows(table(spark, sf, "orders")))


@query("check_columns", "WITH c AS (SELECT *, 1 AS flat, CAST(NULL AS DOUBLE) AS empty FROM customer) " + _union([
    "SELECT 'duplicate_columns' AS check_name, 'info' AS severity, 'table' AS subject, 'duplicates' AS metric, TRUE AS passed, 0::DOUBLE AS value, 0::DOUBLE AS threshold",
    *[row("c", "all_null_column", f"COUNT({c}) > 0", E, f"'{c}'", "nulls", f"COUNT(*) - COUNT({c})")
      for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "flat", "empty")],
    *[row("c", "constant_column", f"NOT (COUNT({c}) = 0 OR (COUNT({c}) = COUNT(*) AND MIN({c}) = MAX({c})))", E, f"'{c}'", "is_constant",
          f"CASE WHEN COUNT({c}) = 0 OR (COUNT({c}) = COUNT(*) AND MIN({c}) = MAX({c})) THEN 1 ELSE 0 END", 0)
      for c in ("c_custkey", "c_nationkey", "c_acctbal", "flat", "empty")]]))
def _columns(spark, sf):
    df = table(spark, sf, "customer").withColumns({"flat": F.lit(1), "empty": F.lit(None).cast("double")})
    return shown(tc.check_columns(df))


def rates_sql(src: str, cols, lo: float, hi: float, move: float) -> str:
    prior = "OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    facts = "rp AS (SELECT *, " + ", ".join(f"LAST_VALUE({c} IGNORE NULLS) {prior} AS p_{c}" for c in cols) + f" FROM {src}), rf AS (" + _union(
        f"SELECT '{c}' AS \"column\", MIN({c}) AS lo, MAX({c}) AS hi, MAX(abs(({c} - p_{c}) / NULLIF(p_{c}, 0)) * 100) AS mv, "
        + ("MAX(abs((parallel_rate - official_rate) / NULLIF(official_rate, 0) * 100))" if c == "official_rate" else "CAST(NULL AS DOUBLE)")
        + " AS sp FROM rp" for c in cols) + ")"
    rules = [("negative_rate", "lo < 0", "lo", 0), ("minimum_rate", f"lo < {lo}", "lo", lo), ("maximum_rate", f"hi > {hi}", "hi", hi),
             ("daily_change", f"mv > {move}", "mv", move), ("rate_spread", "sp > 100", "sp", 100)]
    return facts, [row("rf", n, f"NOT COALESCE({bad}, FALSE)", E, '"column"', n, v, t, "sp IS NOT NULL" if n == "rate_spread" else "TRUE")
                   for n, bad, v, t in rules]


_RATE_FACTS, _RATE_ROWS = rates_sql("rates", RATE_COLS, 100.0, 2000.0, 20.0)


@query("check_rates", f"WITH {RATES_CTE}, {_RATE_FACTS} " + _union(_RATE_ROWS))
def _rates(spark, sf):
    return shown(tc.check_rates(daily_rates(spark, sf), **BY))


_TS = """ts AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, o_orderkey FROM orders),
  tf AS (SELECT series, COUNT(*) AS n, COUNT(DISTINCT date) AS d, COUNT(*) FILTER (WHERE date > DATE '{a}') AS fut,
    MIN(date) AS lo, MAX(date) AS hi FROM ts GROUP BY 1),
  tl AS (SELECT series, COUNT(*) FILTER (WHERE prior > date) AS late FROM (SELECT *, LAG(date) OVER (PARTITION BY series ORDER BY o_orderkey) AS prior FROM ts) GROUP BY 1),
  tt AS (SELECT * FROM tf JOIN tl USING (series))"""


@query("check_time_series", f"WITH {_TS.format(a='2001-07-01')} " + _union([
    row("tt", "unique_dates", "n = d", E, "series", "duplicate_dates", "n - d", 0),
    row("tt", "missing_dates", "hi - lo + 1 = d", E, "series", "missing_dates", "hi - lo + 1 - d", 0),
    row("tt", "future_dates", "fut = 0", E, "series", "future_dates", "fut", 0),
    row("tt", "stale_data", "DATE '2001-07-01' - hi <= 7", E, "series", "days_old", "DATE '2001-07-01' - hi", 7),
    row("tt", "sorted_dates", "late = 0", E, "series", "out_of_order", "late", 0)]))
def _time_series(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date"), "o_orderkey")
    return shown(tc.check_time_series(df, "date", "2001-07-01", key=["series"], seq="o_orderkey"))


# The dates behind the failed series checks, one row each.
@query("series_evidence", """WITH d AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, COUNT(*) AS n FROM orders GROUP BY 1, 2),
  g AS (SELECT *, d - LAG(d) OVER (PARTITION BY series ORDER BY d) AS gap FROM d),
  e AS (SELECT 'unique_dates' AS check_name, series AS subject, 'dates' AS key, ROW_NUMBER() OVER (PARTITION BY series ORDER BY d) - 1 AS pos, CAST(d AS VARCHAR) AS text FROM d WHERE n > 1
    UNION ALL SELECT 'missing_dates', series, 'missing', ROW_NUMBER() OVER (PARTITION BY series ORDER BY d) - 1,
      CAST(CAST(d - CAST(gap AS INTEGER) + 1 AS DATE) AS VARCHAR) || '..' || CAST(CAST(d - 1 AS DATE) AS VARCHAR) FROM g WHERE gap > 1)
  SELECT * FROM e WHERE pos < 10""")
def _series_evidence(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date"))
    shown_rows = shown_evidence(tc.check_time_series(df, "date", "2001-07-01", key=["series"]))
    return shown_rows.where(F.col("text").isNotNull()).select("check_name", "subject", "key", "pos", "text")


@query("check_series_v2", f"""WITH sv AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders),
  f AS (SELECT COUNT(*) AS n, COUNT(DISTINCT d) AS u, MIN(d) AS lo, MAX(d) AS hi FROM sv) """ + _union([
    "SELECT 'date_type' AS check_name, 'info' AS severity, 'date' AS subject, 'is_date' AS metric, TRUE AS passed, 1::DOUBLE AS value, 1::DOUBLE AS threshold",
    row("f", "null_dates", "TRUE", E, "'date'", "null_dates", "0", 0), row("f", "date_range", "TRUE", "'info'", "'date'", "range_days", "hi - lo"),
    row("f", "staleness", "DATE '2001-09-01' - hi <= 7", E, "'date'", "days_old", "DATE '2001-09-01' - hi", 7),
    row("f", "duplicate_dates", "n = u", W, "'date'", "duplicate_dates", "n - u", 0)]))
def _series_v2(spark, sf):
    df = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return shown(tc.check_series_v2(df, "date", "2001-09-01"))


_CF = ["cbn_rates_central_rate", "eia_brent_price_usd", "dmo_debt_total_debt", "dmo_debt_external_debt", "dmo_debt_domestic_debt",
       "worldbank_reserves_reserves_usd", "news_sentiment_sentiment_score", "news_sentiment_relevance_score"]
_CF_COLS = ["series", "date", *_CF, "sentiment_label"]


@query("check_features", f"WITH {MARKET_CTE}, zs AS (" + _union(
    f"SELECT '{c}' AS \"column\", COUNT(*) AS n, COUNT(*) FILTER (WHERE abs(({c} - (SELECT AVG({c}) FROM market)) / "
    f"NULLIF((SELECT STDDEV_SAMP({c}) FROM market), 0)) > 3) AS o FROM market" for c in _CF) + "), cp AS (" + _union(
    f"SELECT '{a}~{b}' AS pair, {sql_corr(a, b)} AS r FROM market" for a, b in combinations(_CF, 2)) + ") " + _union([
        "SELECT 'feature_count' AS check_name, 'info' AS severity, 'features' AS subject, 'columns' AS metric, TRUE AS passed, 11::DOUBLE AS value, 10::DOUBLE AS threshold",
        row("cp", "correlated_pair", "NOT COALESCE(abs(r) > 0.95, FALSE)", E, "pair", "correlation", "r", 0.95),
        row("zs", "zscore_share", "NOT (o * 100.0::DOUBLE / n > 5)", E, '"column"', "outlier_pct", "o * 100.0::DOUBLE / n", 5),
        *[f"SELECT '{k}_leakage' AS check_name, '{'error' if hit else 'info'}' AS severity, '{c}' AS subject, 'name_match' AS metric, "
          f"{not hit} AS passed, {float(hit)}::DOUBLE AS value, 0::DOUBLE AS threshold"
          for c in _CF_COLS for k, hit in (("future", False), ("target", "label" in c))]]))
def _features(spark, sf):
    df = align_sources(market_sources(spark, sf)).select("series", "date", *_CF, F.col("series").alias("sentiment_label"))
    return shown(fc.check_features(df))


def _two(src, name, value, warn, err, metric) -> str:
    return row(src, name, f"NOT COALESCE({value} > {warn}, FALSE)", f"CASE WHEN {value} > {err} THEN 'error' ELSE 'warning' END", "'table'", metric, value, warn)


@query("check_table", f"WITH {RATES_CTE}, " + """cells AS (SELECT COUNT(*) AS n, (2 * COUNT(*) - COUNT(official_rate) - COUNT(parallel_rate)) * 100::DOUBLE / (4 * COUNT(*)) AS p FROM rates) """
       + _union([row("cells", "table_rows", "n > 0", E, "'table'", "rows", "n", 1), _two("cells", "table_nulls", "p", 10, 20, "null_pct"),
                 row("cells", "table_duplicates", "TRUE", E, "'table'", "duplicate_pct", "0", 5)]))
def _table(spark, sf):
    return shown(tc.check_table(merge_blocks(daily_rates(spark, sf))))


@query("check_table_duplicates", """WITH g AS (SELECT event_type, CAST(ts AS DATE) AS d, props, COUNT(*) AS n FROM events GROUP BY 1, 2, 3),
  f AS (SELECT SUM(n) AS n, SUM(n - 1) * 100::DOUBLE / SUM(n) AS p FROM g) """ + _union([
           row("f", "table_rows", "n > 0", E, "'table'", "rows", "n", 1), row("f", "table_nulls", "TRUE", E, "'table'", "null_pct", "0", 10),
           _two("f", "table_duplicates", "p", 5, 10, "duplicate_pct")]))
def _table_dups(spark, sf):
    return shown(tc.check_table(table(spark, sf, "events").select("event_type", F.to_date("ts").alias("d"), "props")))


_NUM = ["value", "k"]


@query("check_numeric", f"WITH {RAW_CTE}, q AS ({sql_fences('value', 'raw')} UNION ALL {sql_fences('k', 'raw')}), nf AS (" + _union(
    f"SELECT '{c}' AS \"column\", COUNT({c}) AS n, COUNT(*) FILTER (WHERE isinf({c})) AS inf, "
    f"COUNT(*) FILTER (WHERE {c} < (SELECT q1 - 1.5 * (q3 - q1) FROM q WHERE \"column\" = '{c}') OR {c} > (SELECT q3 + 1.5 * (q3 - q1) FROM q WHERE \"column\" = '{c}')) * 100::DOUBLE / COUNT({c}) AS o, "
    f"COUNT(*) FILTER (WHERE abs(({c} - (SELECT AVG({c}) FROM raw)) / NULLIF((SELECT STDDEV_SAMP({c}) FROM raw), 0)) > 5) AS x FROM raw" for c in _NUM) + ") " + _union([
        "SELECT 'numeric_type' AS check_name, 'error' AS severity, 'source' AS subject, 'is_numeric' AS metric, FALSE AS passed, 0::DOUBLE AS value, 1::DOUBLE AS threshold",
        row("nf", "all_null", "n > 0", E, '"column"', "valid_count", "n", 1),
        row("nf", "infinite_values", "inf = 0", E, '"column"', "infinite_count", "inf", 0, "n > 0"),
        row("nf", "iqr_share", "NOT COALESCE(o > 5, FALSE)", "CASE WHEN o > 10 THEN 'error' ELSE 'warning' END", '"column"', "outlier_pct", "o", 5),
        row("nf", "extreme_values", "x = 0", W, '"column"', "extreme_count", "x", 5)]))
def _numeric(spark, sf):
    raw = raw_events(spark, sf)
    df = raw.select("source", "value", F.get_json_object("data", "$.k").cast("double").alias("k"))
    return shown(tc.check_numeric(df, ["source", *_NUM]))


_CATS = ["p_brand", "p_type", "p_name"]
_CAT = "c AS (" + _union(f"SELECT '{c}' AS \"column\", {c} AS category, COUNT(*) AS n FROM part GROUP BY 2" for c in _CATS) + \
       "), f AS (SELECT \"column\", COUNT(*) AS u, SUM(n) AS r, MAX(n) AS hi, MIN(n) AS lo FROM c GROUP BY 1)"


@query("check_categorical", f"WITH {_CAT} " + _union([
    "SELECT 'category_column' AS check_name, 'error' AS severity, 'p_absent' AS subject, 'present' AS metric, FALSE AS passed, 0::DOUBLE AS value, 1::DOUBLE AS threshold",
    row("f", "cardinality", "NOT u > r * 0.5", W, '"column"', "unique_ratio", "u::DOUBLE / r", 0.5),
    row("f", "imbalance", "NOT (u > 1 AND hi > lo * 10)", W, '"column"', "max_to_min", "hi::DOUBLE / lo", 10, "u > 1")]))
def _categorical(spark, sf):
    return shown(tc.check_categorical(table(spark, sf, "part"), [*_CATS, "p_absent"]))


@query("check_schema", """WITH f AS (SELECT MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer) """ + _union([
    *[f"SELECT '{n}' AS check_name, '{sev}' AS severity, '{c}' AS subject, '{m}' AS metric, {ok} AS passed, {v}::DOUBLE AS value, 1::DOUBLE AS threshold"
      for n, sev, c, m, ok, v in [("required_column", "info", "c_custkey", "present", True, 1), ("required_column", "error", "c_phone", "present", False, 0),
                                  ("column_type", "info", "c_acctbal", "type_matches", True, 1), ("column_type", "error", "c_name", "type_matches", False, 0)]],
    row("f", "min_value", "NOT lo < 0", E, "'c_acctbal'", "min_value", "lo", 0), row("f", "max_value", "NOT hi > 1000000", E, "'c_acctbal'", "max_value", "hi", 1000000)]))
def _schema(spark, sf):
    return shown(tc.check_schema(table(spark, sf, "customer"), ["c_custkey", "c_phone"],
                                 {"c_acctbal": T.DoubleType(), "c_name": T.DateType()}, {"c_acctbal": (0.0, 1e6)}))


_QUALITY = f"""q0 AS (SELECT COUNT(*) AS n, 1 - (2 * COUNT(*) - COUNT(official_rate) - COUNT(parallel_rate))::DOUBLE / (4 * COUNT(*)) AS comp,
    COUNT(DISTINCT date) AS u, MAX(date) AS hi FROM rates),
  q1 AS (SELECT comp, (CASE WHEN (1 - comp) * 100 > 20 THEN 1 ELSE 0 END + CASE WHEN comp < 0.8 THEN 1 ELSE 0 END
      + CASE WHEN DATE '2001-09-01' - hi > 7 THEN 1 ELSE 0 END) AS errors,
    (CASE WHEN (1 - comp) * 100 > 10 AND (1 - comp) * 100 <= 20 THEN 1 ELSE 0 END + CASE WHEN n > u THEN 1 ELSE 0 END) AS warnings FROM q0),
  q2 AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, 1 - 0.2::DOUBLE * errors - 0.1::DOUBLE * warnings)) AS v FROM q1)"""


@query("score_quality", f"""WITH {RATES_CTE}, {_QUALITY} SELECT {s6('comp')} AS completeness, CAST(errors AS BIGINT) AS errors,
  CAST(warnings AS BIGINT) AS warnings, {s6('v')} AS validation_score, {s6('0.4::DOUBLE * comp + 0.6::DOUBLE * v')} AS quality_score FROM q2""")
def _quality(spark, sf):
    out = tc.score_quality(merge_blocks(daily_rates(spark, sf)), "2001-09-01")
    return out.select(r6("completeness").alias("completeness"), "errors", "warnings", r6("validation_score").alias("validation_score"),
                      r6("quality_score").alias("quality_score"))


@query("check_negative_price", "WITH f AS (SELECT MIN(c_acctbal) AS lo FROM customer) "
       + row("f", "negative_price", "NOT COALESCE(lo < 0, FALSE)", W, "'c_acctbal'", "min", "lo", 0))
def _negative(spark, sf):
    return shown(tc.check_negative_price(table(spark, sf, "customer"), "c_acctbal"))


@query("check_fx", f"WITH {DAILY_CTE}, f AS (SELECT MIN(price) AS lo, MAX(price) AS hi, AVG(price) AS m, STDDEV_SAMP(price) AS s FROM daily) " + _union([
    *[f"SELECT '{n}' AS check_name, 'info' AS severity, '{c}' AS subject, '{m}' AS metric, TRUE AS passed, 1::DOUBLE AS value, 1::DOUBLE AS threshold"
      for n, m in (("required_column", "present"), ("column_type", "type_matches")) for c in ("date", "price")],
    row("f", "min_value", "NOT lo < 0", E, "'price'", "min_value", "lo", 0), row("f", "max_value", "NOT hi > 10000", E, "'price'", "max_value", "hi", 10000),
    row("f", "fx_mean", "m BETWEEN 100 AND 5000", W, "'price'", "mean", "m", 5000),
    row("f", "fx_volatility", "NOT s > m * 0.5", W, "'price'", "std", "s", "m * 0.5")]))
def _fx(spark, sf):
    return shown(tc.check_fx(merge_blocks(daily_prices(spark, sf)), "price"))

