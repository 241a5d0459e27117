"""Registry, the frames built from the tables, and their SQL twins.

The tables stand in for daily market data: ``events`` is the raw table (event type = source),
``orders`` per day and priority is a price series, orders by status are official and parallel
rates, and ``lineitem`` gives oil prices, monthly debt and a sentiment score.

Sums go through DECIMAL so that both engines start from identical doubles. ``r4`` and ``r6``
round results of floating-point windows; the small shift keeps exact decimal ties (x.xxxx5)
off the rounding edge, where the last bit of a sum would decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.windows import daily_series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EVENT_SOURCES = ("click", "error", "purchase", "signup", "view")
# One declared source has no rows, as when a feed is down.
DECLARED = (*EVENT_SOURCES, "refund")
EVENTS_AS_OF = "2024-01-31"
ORDERS_AS_OF = "2001-08-02"
MONEY = "DECIMAL(18,2)"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r4(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(0.0000123457), 4)


def r6(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(0.000000123457), 6)


def s4(expr: str) -> str:
    return f"round(({expr}) + 0.0000123457::DOUBLE, 4)"


def s6(expr: str) -> str:
    return f"round(({expr}) + 0.000000123457::DOUBLE, 6)"


def rounded(df: DataFrame, keep: list[str], four: list[str] = (), six: list[str] = ()) -> DataFrame:
    return df.select(*keep, *[r4(c).alias(c) for c in four], *[r6(c).alias(c) for c in six])


def sql_rounded(keep: list[str], four: dict[str, str] | None = None, six: dict[str, str] | None = None) -> str:
    parts = [*keep, *[f"{s4(e)} AS {n}" for n, e in (four or {}).items()],
             *[f"{s6(e)} AS {n}" for n, e in (six or {}).items()]]
    return ", ".join(parts)


def money(c: str, when: Column | None = None) -> Column:
    """Exact sum of a money column as double."""
    x = F.col(c).cast(MONEY)
    return F.sum(x if when is None else F.when(when, x)).cast("double")


def money_avg(c: str, when: Column | None = None) -> Column:
    n = F.count(c if when is None else F.when(when, F.col(c)))
    return money(c, when) / F.nullif(n, F.lit(0))


def sql_money(c: str, when: str | None = None) -> str:
    x = f"CAST({c} AS {MONEY})"
    return f"CAST(SUM({x if when is None else f'CASE WHEN {when} THEN {x} END'}) AS DOUBLE)"


def sql_money_avg(c: str, when: str | None = None) -> str:
    n = f"COUNT({c})" if when is None else f"COUNT(CASE WHEN {when} THEN {c} END)"
    return f"({sql_money(c, when)} / NULLIF({n}, 0))"


# --- raw table --------------------------------------------------------------------------

def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` in the raw layout, with its id, user and value kept beside it."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("series"),
        F.to_date("ts").alias("date"), F.col("props").alias("data"), F.col("ts").alias("ingested_at"),
        "event_id", "user_id", "value")


RAW_CTE = """raw AS (
  SELECT event_type AS source, CAST(user_id AS VARCHAR) AS series, CAST(ts AS DATE) AS date, props AS data,
         ts AS ingested_at, event_id, user_id, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k
  FROM events)"""


# --- price series -----------------------------------------------------------------------

def daily_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Average order value per (priority, day): five series with real calendar gaps."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return daily_series(orders, {"price": money_avg("o_totalprice")}, key=["series"], order="date")


DAILY_CTE = f"""daily AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, {sql_money_avg('o_totalprice')} AS price
  FROM orders GROUP BY 1, 2)"""

W = "OVER (PARTITION BY series ORDER BY date)"


def rows_w(n: int, w: str = "PARTITION BY series ORDER BY date") -> str:
    return f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, c: str, n: int) -> str:
    return f"CASE WHEN COUNT({c}) {rows_w(n)} = {n} THEN {agg}({c}) {rows_w(n)} END"


# --- official and parallel rates --------------------------------------------------------

def daily_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per (priority, day): mean value of finished orders (official) and of open ones (parallel); nulls occur."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderstatus")
    return daily_series(orders, {
        "official_rate": money_avg("o_totalprice", F.col("o_orderstatus") == "F"),
        "parallel_rate": money_avg("o_totalprice", F.col("o_orderstatus") == "O"),
    }, key=["series"], order="date")


RATES_CTE = f"""rates AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,
         {sql_money_avg('o_totalprice', "o_orderstatus = 'F'")} AS official_rate,
         {sql_money_avg('o_totalprice', "o_orderstatus = 'O'")} AS parallel_rate
  FROM orders GROUP BY 1, 2)"""


# --- sentiment --------------------------------------------------------------------------

def daily_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Per (user, day): mean of ``1 - 2k/99`` over the user's events, in [-1, 1]."""
    k = F.get_json_object("props", "$.k").cast("double")
    score = F.round(1 - 2 * k / 99, 4).cast("DECIMAL(8,4)")
    ev = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("series"), F.to_date("ts").alias("date"), score.alias("score"))
    return daily_series(ev, {"sentiment_score": F.sum("score").cast("double") / F.count("score")},
                        key=["series"], order="date")


SENTIMENT_CTE = """sentiment AS (
  SELECT CAST(user_id AS VARCHAR) AS series, CAST(ts AS DATE) AS date,
         CAST(SUM(CAST(round(1 - 2 * CAST(json_extract(props, '$.k') AS DOUBLE) / 99, 4) AS DECIMAL(8,4))) AS DOUBLE)
           / COUNT(*) AS sentiment_score
  FROM events GROUP BY 1, 2)"""


# --- five sources on one grid -----------------------------------------------------------

def market_sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The five sources as (series, date, fields...); series is the order status."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("series"), F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderpriority")
    items = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("series"), F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity",
        "l_discount", "l_tax", "l_returnflag")
    by = ["series", "date"]
    month = F.trunc("date", "month").cast("date").alias("date")
    rates = orders.groupBy(*by).agg(
        money_avg("o_totalprice").alias("central_rate"),
        money_avg("o_totalprice", F.col("o_orderpriority") == "1-URGENT").alias("official_rate"),
        money_avg("o_totalprice", F.col("o_orderpriority") == "5-LOW").alias("parallel_rate"))
    oil = items.groupBy(*by).agg((money("l_extendedprice") / money("l_quantity")).alias("price_usd"))
    debt = items.groupBy("series", month).agg(
        money("l_extendedprice").alias("total_debt"),
        money("l_extendedprice", F.col("l_returnflag") == "R").alias("external_debt"),
        money("l_extendedprice", F.col("l_returnflag") != "R").alias("domestic_debt"),
        money("l_extendedprice", F.col("l_returnflag") == "A").alias("debt_servicing"))
    reserves = orders.groupBy("series", month).agg(money("o_totalprice").alias("reserves_usd"))
    news = items.groupBy(*by).agg((1 - 20 * money_avg("l_discount")).alias("sentiment_score"),
                                  money_avg("l_tax").alias("relevance_score"))
    return {"cbn_rates": rates, "worldbank_reserves": reserves, "dmo_debt": debt, "eia_brent": oil,
            "news_sentiment": news}


MARKET_CTE = f"""o AS (SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS date, o_totalprice, o_orderpriority
  FROM orders),
i AS (SELECT l_linestatus AS series, CAST(l_shipdate AS DATE) AS date, l_extendedprice, l_quantity, l_discount, l_tax,
  l_returnflag FROM lineitem),
cbn AS (SELECT series, date, {sql_money_avg('o_totalprice')} AS central_rate,
  {sql_money_avg('o_totalprice', "o_orderpriority = '1-URGENT'")} AS official_rate,
  {sql_money_avg('o_totalprice', "o_orderpriority = '5-LOW'")} AS parallel_rate FROM o GROUP BY 1, 2),
oil AS (SELECT series, date, {sql_money('l_extendedprice')} / {sql_money('l_quantity')} AS price_usd FROM i GROUP BY 1, 2),
debt AS (SELECT series, CAST(date_trunc('month', date) AS DATE) AS date, {sql_money('l_extendedprice')} AS total_debt,
  {sql_money('l_extendedprice', "l_returnflag = 'R'")} AS external_debt,
  {sql_money('l_extendedprice', "l_returnflag <> 'R'")} AS domestic_debt,
  {sql_money('l_extendedprice', "l_returnflag = 'A'")} AS debt_servicing FROM i GROUP BY 1, 2),
reserves AS (SELECT series, CAST(date_trunc('month', date) AS DATE) AS date, {sql_money('o_totalprice')} AS reserves_usd
  FROM o GROUP BY 1, 2),
news AS (SELECT series, date, 1 - 20 * {sql_money_avg('l_discount')} AS sentiment_score,
  {sql_money_avg('l_tax')} AS relevance_score FROM i GROUP BY 1, 2),
market AS (
  SELECT series, date,
    central_rate AS cbn_rates_central_rate, official_rate AS cbn_rates_official_rate,
    parallel_rate AS cbn_rates_parallel_rate, price_usd AS eia_brent_price_usd,
    total_debt AS dmo_debt_total_debt, external_debt AS dmo_debt_external_debt,
    domestic_debt AS dmo_debt_domestic_debt, debt_servicing AS dmo_debt_debt_servicing,
    reserves_usd AS worldbank_reserves_reserves_usd,
    sentiment_score AS news_sentiment_sentiment_score, relevance_score AS news_sentiment_relevance_score
  FROM cbn FULL JOIN oil USING (series, date) FULL JOIN debt USING (series, date)
       FULL JOIN reserves USING (series, date) FULL JOIN news USING (series, date))"""

MARKET_COLS = ["cbn_rates_central_rate", "cbn_rates_official_rate", "cbn_rates_parallel_rate", "eia_brent_price_usd",
               "dmo_debt_total_debt", "dmo_debt_external_debt", "dmo_debt_domestic_debt", "dmo_debt_debt_servicing",
               "worldbank_reserves_reserves_usd", "news_sentiment_sentiment_score", "news_sentiment_relevance_score"]
