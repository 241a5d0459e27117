"""Window features (WIN, FN and the documented-only time-series features)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (DAILY_CTE, RATES_CTE, RAW_CTE, SENTIMENT_CTE, W, daily_prices, daily_rates,
                          daily_sentiment, full, query, r4, raw_events, rounded, s4, s6, sql_rounded, table)
from tidemark.operators import indicators as ind
from tidemark.operators import windows as win
from tidemark.operators.blocks import merge_blocks, split_series
from tidemark.operators.derived import calendar_features, calendar_flags, cyclical_features
from tidemark.operators.ewm import decay, ewm_mean

BY = {"key": ["series"], "order": "date"}
SD = ["series", "date"]
LAGS = win.LAGS


@query("lag_features", f"""WITH {DAILY_CTE} SELECT series, date, price,
  {', '.join(f'LAG(price, {n}) {W} AS price_lag_{n}' for n in LAGS)} FROM daily""")
def _lags(spark, sf):
    return merge_blocks(win.lag_features(daily_prices(spark, sf), ["price"], **BY))


_STATS = {"mean": "AVG", "std": "STDDEV_SAMP", "min": "MIN", "max": "MAX"}


@query("rolling_stats", f"""WITH {DAILY_CTE} SELECT {sql_rounded(SD, four={
    f'price_rolling_{s}_{n}': full(f, 'price', n) for n in win.WINDOWS for s, f in _STATS.items()})} FROM daily""")
def _rolling(spark, sf):
    out = merge_blocks(win.rolling_stats(daily_prices(spark, sf), ["price"], **BY))
    return rounded(out, SD, [f"price_rolling_{s}_{n}" for n in win.WINDOWS for s in _STATS])


# Event-level rows, one series per event type: split into blocks of at most 400 rows plus halo.
@query("rolling_stats_hot_series", f"""WITH {RAW_CTE} SELECT event_id,
  LAG(value, 7) OVER (PARTITION BY source ORDER BY ingested_at, event_id) AS value_lag_7,
  {s4("CASE WHEN COUNT(value) OVER w = 30 THEN AVG(value) OVER w END")} AS value_rolling_mean_30,
  MAX(value) OVER w AS value_max_30
  FROM raw WINDOW w AS (PARTITION BY source ORDER BY ingested_at, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _hot(spark, sf):
    ev = raw_events(spark, sf).select("source", "ingested_at", "event_id", "value")
    by = {"key": ["source"], "order": ["ingested_at", "event_id"]}
    parts = split_series(ev, lookback=30, rows=400, **by)
    out = win.rolling_stats(win.lag_features(parts, ["value"], (7,), **by), ["value"], (30,), ("mean",), **by)
    w = win.series_window([*by["key"], "__block"], by["order"]).rowsBetween(-29, 0)
    out = merge_blocks(out.withColumn("value_max_30", F.max("value").over(w)))
    return out.select("event_id", "value_lag_7", r4("value_rolling_mean_30").alias("value_rolling_mean_30"), "value_max_30")


_RSI_SQL = f"""moved AS (SELECT *, price - LAG(price) {W} AS d FROM daily),
gl AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS g, CASE WHEN d < 0 THEN -d ELSE 0 END AS l FROM moved),
avgs AS (SELECT *, {full('AVG', 'g', 14)} AS ag, {full('AVG', 'l', 14)} AS al FROM gl)"""


@query("rsi", f"""WITH {DAILY_CTE}, {_RSI_SQL} SELECT series, date,
  {s6('CASE WHEN al = 0 AND ag > 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / NULLIF(al, 0)) END')} AS price_rsi FROM avgs""")
def _rsi(spark, sf):
    return rounded(merge_blocks(ind.rsi(daily_prices(spark, sf), ["price"], **BY)), SD, six=["price_rsi"])


def _ewm_sql(src: str, col: str, span: int, out: str, rows: int = 480) -> str:
    g = decay(span)
    return (f"{out} AS (SELECT a.series, a.rn, CASE WHEN ANY_VALUE(a.{col}) IS NOT NULL THEN "
            f"SUM(b.{col} * pow({g!r}::DOUBLE, a.rn - b.rn)) / "
            f"SUM(CASE WHEN b.{col} IS NOT NULL THEN pow({g!r}::DOUBLE, a.rn - b.rn) END) END AS y "
            f"FROM {src} a JOIN {src} b ON a.series = b.series AND b.rn <= a.rn AND b.rn >= a.rn - {rows} GROUP BY 1, 2)")


@query("ewm_mean", f"""WITH {RATES_CTE}, n AS (SELECT *, ROW_NUMBER() {W} AS rn FROM rates),
  {_ewm_sql('n', 'official_rate', 12, 'e')}
  SELECT series, date, {s4('y')} AS official_rate_ewm_12 FROM n JOIN e USING (series, rn)""")
def _ewm(spark, sf):
    out = ewm_mean(daily_rates(spark, sf), ["official_rate"], 12, **BY)
    return rounded(merge_blocks(out), SD, ["official_rate_ewm_12"])


@query("macd", f"""WITH {DAILY_CTE}, n AS (SELECT *, ROW_NUMBER() {W} AS rn FROM daily),
  {_ewm_sql('n', 'price', 12, 'f')}, {_ewm_sql('n', 'price', 26, 's')},
  m AS (SELECT f.series, f.rn, f.y - s.y AS macd FROM f JOIN s USING (series, rn)), {_ewm_sql('m', 'macd', 9, 'g')}
  SELECT series, date, {s4('macd')} AS price_macd, {s4('g.y')} AS price_macd_signal,
         {s4('macd - g.y')} AS price_macd_histogram
  FROM n JOIN m USING (series, rn) JOIN g USING (series, rn)""")
def _macd(spark, sf):
    out = merge_blocks(ind.macd(daily_prices(spark, sf), ["price"], **BY))
    return rounded(out, SD, ["price_macd", "price_macd_signal", "price_macd_histogram"])


@query("bollinger", f"""WITH {DAILY_CTE}, b AS (SELECT *, {full('AVG', 'price', 20)} AS m,
  {full('STDDEV_SAMP', 'price', 20)} AS s FROM daily), u AS (SELECT *, m + 2.0 * s AS hi, m - 2.0 * s AS lo FROM b)
  SELECT {sql_rounded(SD, {'price_bb_middle': 'm', 'price_bb_upper': 'hi', 'price_bb_lower': 'lo',
                           'price_bb_bandwidth': 'hi - lo'},
                      {'price_bb_percent': '(price - lo) / NULLIF(hi - lo, 0)'})} FROM u""")
def _bollinger(spark, sf):
    out = merge_blocks(ind.bollinger(daily_prices(spark, sf), ["price"], **BY))
    return rounded(out, SD, [f"price_bb_{p}" for p in ("middle", "upper", "lower", "bandwidth")], ["price_bb_percent"])


def _chg(c: str, n: int) -> str:
    lag = f"LAG({c}, {n}) {W}"
    return f"({c} - {lag}) / NULLIF({lag}, 0)"


@query("momentum_roc", f"""WITH {DAILY_CTE} SELECT {sql_rounded(SD, six={
    **{f'price_momentum_{n}': _chg('price', n) + ' * 100' for n in (5, 10, 20)},
    'price_roc_10': f'price / NULLIF(LAG(price, 10) {W}, 0) - 1'})} FROM daily""")
def _momentum(spark, sf):
    out = merge_blocks(ind.momentum(daily_prices(spark, sf), ["price"], **BY))
    return rounded(out, SD, six=["price_momentum_5", "price_momentum_10", "price_momentum_20", "price_roc_10"])


@query("pct_change", f"""WITH {RATES_CTE} SELECT {sql_rounded(SD, six={
    f'{c}_pct_change': _chg(c, 1) + ' * 100' for c in ('official_rate', 'parallel_rate')})} FROM rates""")
def _pct(spark, sf):
    out = merge_blocks(win.pct_change(daily_rates(spark, sf), ["official_rate", "parallel_rate"], **BY))
    return rounded(out, SD, six=["official_rate_pct_change", "parallel_rate_pct_change"])


_FF = "OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("forward_fill", f"""WITH {RATES_CTE} SELECT series, date,
  {', '.join(f'LAST_VALUE({c} IGNORE NULLS) {_FF} AS {c}' for c in ('official_rate', 'parallel_rate'))} FROM rates""")
def _ffill(spark, sf):
    return merge_blocks(win.forward_fill(daily_rates(spark, sf), ["official_rate", "parallel_rate"], **BY))


@query("sentiment_window", f"""WITH {SENTIMENT_CTE} SELECT {sql_rounded(SD, six={
    'sentiment_score_rolling_mean': full('AVG', 'sentiment_score', 7),
    'sentiment_score_rolling_std': full('STDDEV_SAMP', 'sentiment_score', 7),
    'sentiment_score_change': f'sentiment_score - LAG(sentiment_score) {W}',
    'sentiment_score_momentum': f'sentiment_score - LAG(sentiment_score, 7) {W}'})} FROM sentiment""")
def _sentiment(spark, sf):
    out = merge_blocks(ind.sentiment_features(daily_sentiment(spark, sf), ["sentiment_score"], **BY))
    return rounded(out, SD, six=[f"sentiment_score_{p}" for p in ("rolling_mean", "rolling_std", "change", "momentum")])


@query("sentiment_flags", f"""WITH {SENTIMENT_CTE} SELECT series, date, sentiment_score,
  sentiment_score > 0.7::DOUBLE AS sentiment_score_very_positive, sentiment_score < -0.7::DOUBLE AS sentiment_score_very_negative,
  abs(sentiment_score) < 0.1::DOUBLE AS sentiment_score_neutral FROM sentiment""")
def _flags(spark, sf):
    return merge_blocks(ind.sentiment_flags(daily_sentiment(spark, sf), ["sentiment_score"]))


@query("sentiment_bucket", f"""WITH {SENTIMENT_CTE} SELECT series, date,
  CASE WHEN sentiment_score < -0.1::DOUBLE THEN 'negative' WHEN sentiment_score > 0.1::DOUBLE THEN 'positive' ELSE 'neutral' END
    AS sentiment_score_bucket, {s6(f'SUM(sentiment_score) {_FF}')} AS sentiment_score_cumulative FROM sentiment""")
def _bucket(spark, sf):
    df = ind.sentiment_bucket(daily_sentiment(spark, sf), "sentiment_score")
    out = merge_blocks(win.cumulative_sum(df, ["sentiment_score"], **BY))
    return rounded(out, [*SD, "sentiment_score_bucket"], six=["sentiment_score_cumulative"])


@query("date_gaps", f"""WITH {DAILY_CTE}, g AS (SELECT series, LAG(date) {W} AS start_date, date AS end_date FROM daily)
  SELECT series, start_date, end_date, CAST(end_date - start_date AS INTEGER) AS gap_days FROM g
  WHERE end_date - start_date > 1""")
def _gaps(spark, sf):
    return win.date_gaps(daily_prices(spark, sf), **BY)


@query("missing_dates", f"""WITH {DAILY_CTE}, s AS (SELECT series, CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM daily GROUP BY series) SELECT series, date FROM s ANTI JOIN daily USING (series, date)""")
def _missing(spark, sf):
    return win.missing_dates(daily_prices(spark, sf), **BY)


@query("out_of_order_rows", """WITH s AS (SELECT o_orderpriority AS series, o_orderkey, CAST(o_orderdate AS DATE) AS date,
  LAG(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS prior FROM orders)
  SELECT series, o_orderkey, date FROM s WHERE prior > date""")
def _unsorted(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), "o_orderkey",
                                               F.to_date("o_orderdate").alias("date"))
    return win.out_of_order_rows(orders, "date", key=["series"], seq="o_orderkey")


_VALID = "OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _extreme_sql(c: str) -> str:
    return (f"SELECT series, '{c}' AS \"column\", COUNT(*) FILTER (WHERE abs({c}_chg) > 0.5) AS extreme_changes, "
            f"{s6(f'MAX(abs({c}_chg))')} AS max_abs_change FROM c GROUP BY 1")


@query("extreme_changes", f"""WITH {RATES_CTE}, p AS (SELECT *, LAST_VALUE(official_rate IGNORE NULLS) {_VALID} AS po,
  LAST_VALUE(parallel_rate IGNORE NULLS) {_VALID} AS pp FROM rates),
  c AS (SELECT series, (official_rate - po) / NULLIF(po, 0) AS official_rate_chg,
               (parallel_rate - pp) / NULLIF(pp, 0) AS parallel_rate_chg FROM p)
  {_extreme_sql('official_rate')} UNION ALL {_extreme_sql('parallel_rate')}""")
def _extreme(spark, sf):
    out = win.extreme_changes(daily_rates(spark, sf), ["official_rate", "parallel_rate"], **BY)
    return rounded(out, ["series", "column", "extreme_changes"], six=["max_abs_change"])


@query("zscore_outliers", f"""WITH {DAILY_CTE}, m AS (SELECT series, AVG(price) AS mean, STDDEV_SAMP(price) AS std FROM daily GROUP BY 1),
  z AS (SELECT series, date, 'price' AS "column", price AS value, (price - mean) / NULLIF(std, 0) AS z FROM daily JOIN m USING (series))
  SELECT series, date, "column", value, {s6('z')} AS z FROM z WHERE abs(z) > 1.9""")
def _zscore(spark, sf):
    out = win.zscore_outliers(daily_prices(spark, sf), ["price"], 1.9, key=["series"])
    return rounded(out, ["series", "date", "column", "value"], six=["z"])


@query("calendar_features", f"""WITH {DAILY_CTE} SELECT series, date, CAST(year(date) AS INTEGER) AS year,
  CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) AS INTEGER) AS weekday,
  CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(quarter(date) AS INTEGER) AS quarter FROM daily""")
def _calendar(spark, sf):
    return calendar_features(merge_blocks(daily_prices(spark, sf)).select(*SD))


@query("cyclical_features", f"""WITH {DAILY_CTE} SELECT {sql_rounded(SD, six={
    'month_sin': 'sin(2 * pi() * month(date) / 12)', 'month_cos': 'cos(2 * pi() * month(date) / 12)',
    'day_of_year_sin': 'sin(2 * pi() * dayofyear(date) / 365)',
    'day_of_year_cos': 'cos(2 * pi() * dayofyear(date) / 365)'})} FROM daily""")
def _cyclical(spark, sf):
    out = cyclical_features(daily_prices(spark, sf))
    return rounded(out, SD, six=["month_sin", "month_cos", "day_of_year_sin", "day_of_year_cos"])


@query("calendar_flags", f"""WITH {DAILY_CTE} SELECT series, date, isodow(date) >= 6 AS is_weekend,
  quarter(date) = 1 AS is_q1, month(date) = 12 AS is_december FROM daily""")
def _calendar_flags(spark, sf):
    return calendar_flags(merge_blocks(daily_prices(spark, sf)).select(*SD))


@query("log_returns", f"""WITH {DAILY_CTE} SELECT {sql_rounded(SD, six={
    f'price_log_return_{n}': f'ln(price / NULLIF(LAG(price, {n}) {W}, 0))' for n in (1, 5)})} FROM daily""")
def _log_returns(spark, sf):
    out = merge_blocks(win.log_returns(daily_prices(spark, sf), ["price"], **BY))
    return rounded(out, SD, six=["price_log_return_1", "price_log_return_5"])


@query("days_since_update", f"""WITH {RATES_CTE}, s AS (SELECT series, date,
  LAST_VALUE(CASE WHEN official_rate IS NOT NULL THEN date END IGNORE NULLS) {_FF} AS seen FROM rates)
  SELECT series, date, CAST(date - seen AS INTEGER) AS official_rate_days_since_update FROM s""")
def _days_since(spark, sf):
    out = merge_blocks(win.days_since_update(daily_rates(spark, sf), "official_rate", **BY))
    return out.select(*SD, "official_rate_days_since_update")


@query("regime_flag", f"""WITH {DAILY_CTE}, c AS (SELECT *, {_chg('price', 1)} AS chg FROM daily),
  v AS (SELECT *, {full('STDDEV_SAMP', 'chg', 14)} AS vol FROM c)
  SELECT series, date, {s6('vol')} AS price_volatility, CASE WHEN vol <= 0.35::DOUBLE THEN 'fixed'
    WHEN vol <= 0.6::DOUBLE THEN 'managed_float' WHEN vol IS NOT NULL THEN 'flexible' END AS price_regime FROM v""")
def _regime(spark, sf):
    out = merge_blocks(ind.regime_flag(daily_prices(spark, sf), "price", 14, 0.35, 0.6, **BY))
    return rounded(out, [*SD, "price_regime"], six=["price_volatility"])


@query("rolling_range", f"""WITH {DAILY_CTE} SELECT series, date, {', '.join(
    f"{full('MAX', 'price', n)} - {full('MIN', 'price', n)} AS price_range_{n}" for n in (7, 14, 30))} FROM daily""")
def _range(spark, sf):
    out = merge_blocks(win.rolling_range(daily_prices(spark, sf), ["price"], (7, 14, 30), **BY))
    return out.select(*SD, "price_range_7", "price_range_14", "price_range_30")
