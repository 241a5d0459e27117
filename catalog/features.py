"""Feature frame, feature store, forecasts and labels (PIPE-1, SRC-9..11, FCT, DOC-8..10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (DAILY_CTE, MARKET_CTE, ORDERS_AS_OF, RATES_CTE, W, daily_prices, daily_rates, full, market_sources,
                          query, r4, r6, rounded, s4, s6, sql_rounded, table)
from catalog.windows import _FF, _RSI_SQL
from tidemark.functions.text import message_intent
from tidemark.operators import forecast as fct
from tidemark.operators import indicators as ind
from tidemark.operators import windows as win
from tidemark.operators.blocks import merge_blocks
from tidemark.plans.features import FeatureSpec, create_features
from tidemark.sources.feature_store import latest_features, latest_predictions, pack_features
from tidemark.sources.raw_store import normalise_raw

BY = {"key": ["series"], "order": "date"}
SD = ["series", "date"]


@query("price_indicators", f"""WITH {DAILY_CTE}, {_RSI_SQL}, b AS (SELECT *, {full('AVG', 'price', 20)} AS m, {full('STDDEV_SAMP', 'price', 20)} AS sd FROM avgs)
  SELECT {sql_rounded([*SD, 'price', f'LAG(price, 1) {W} AS price_lag_1', f'LAG(price, 7) {W} AS price_lag_7'],
    {'price_rolling_mean_7': full('AVG', 'price', 7), 'price_rolling_std_7': full('STDDEV_SAMP', 'price', 7),
     'price_bb_middle': 'm', 'price_bb_upper': 'm + 2.0 * sd', 'price_bb_lower': 'm - 2.0 * sd'},
    {'price_rsi': 'CASE WHEN al = 0 AND ag > 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / NULLIF(al, 0)) END'})} FROM b""")
def _price_indicators(spark, sf):
    df = win.lag_features(daily_prices(spark, sf), ["price"], (1, 7), **BY)
    df = win.rolling_stats(df, ["price"], (7,), ("mean", "std"), **BY)
    df = ind.bollinger(ind.rsi(df, ["price"], **BY), ["price"], **BY)
    return rounded(merge_blocks(df), [*SD, "price", "price_lag_1", "price_lag_7"],
                   ["price_rolling_mean_7", "price_rolling_std_7", "price_bb_middle", "price_bb_upper", "price_bb_lower"], ["price_rsi"])


def raw_market(spark, sf):
    """The five sources packed as raw JSON rows."""
    out = None
    for name, df in market_sources(spark, sf).items():
        one = normalise_raw(df, name, F.col("date").cast("timestamp"), F.col("series"))
        out = one if out is None else out.unionByName(one)
    return out


SPEC = FeatureSpec(lags=(1, 7), windows=(7,), lag_cols=["exchange_rate", "oil_price"], rolling_cols=["oil_price"],
                   price_cols=["exchange_rate"], sentiment_cols=["sentiment_score"], pct_cols=["exchange_rate"])
START, END = "1995-01-01", "2001-12-31"

_FRAME = {
    "four": ["rate_spread", "oil_price_rolling_mean_7", "oil_price_rolling_std_7", "exchange_rate_bb_upper"],
    "six": ["exchange_rate_rsi", "exchange_rate_pct_change", "exchange_rate_momentum_5", "reserves_to_debt_ratio",
            "exchange_rate_per_oil", "sentiment_score_rolling_mean", "month_sin"],
    "plain": ["exchange_rate", "oil_price", "fx_reserves", "exchange_rate_lag_1", "oil_price_lag_7", "weekday"],
}
_SRC = """b AS (SELECT series, date, cbn_rates_central_rate AS exchange_rate, cbn_rates_parallel_rate - cbn_rates_central_rate AS rate_spread,
    eia_brent_price_usd AS oil_price, worldbank_reserves_reserves_usd AS fx_reserves, dmo_debt_total_debt AS total_debt,
    news_sentiment_sentiment_score AS sentiment FROM market),
  mv AS (SELECT *, exchange_rate - LAG(exchange_rate) OVER (PARTITION BY series ORDER BY date) AS d FROM b),
  gl AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS g, CASE WHEN d < 0 THEN -d ELSE 0 END AS l FROM mv),
  av AS (SELECT *, """ + full("AVG", "g", 14) + " AS ag, " + full("AVG", "l", 14) + """ AS al FROM gl)"""
_EXPR = {
    "exchange_rate": "exchange_rate", "oil_price": "oil_price", "fx_reserves": "fx_reserves", "rate_spread": "rate_spread",
    "exchange_rate_lag_1": f"LAG(exchange_rate) {W}", "oil_price_lag_7": f"LAG(oil_price, 7) {W}",
    "oil_price_rolling_mean_7": full("AVG", "oil_price", 7), "oil_price_rolling_std_7": full("STDDEV_SAMP", "oil_price", 7),
    "exchange_rate_bb_upper": f"{full('AVG', 'exchange_rate', 20)} + 2.0 * {full('STDDEV_SAMP', 'exchange_rate', 20)}",
    "exchange_rate_rsi": "CASE WHEN al = 0 AND ag > 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / NULLIF(al, 0)) END",
    "exchange_rate_pct_change": f"(exchange_rate - LAG(exchange_rate) {W}) / NULLIF(LAG(exchange_rate) {W}, 0) * 100",
    "exchange_rate_momentum_5": f"(exchange_rate - LAG(exchange_rate, 5) {W}) / NULLIF(LAG(exchange_rate, 5) {W}, 0) * 100",
    "reserves_to_debt_ratio": "fx_reserves / NULLIF(total_debt, 0)", "exchange_rate_per_oil": "exchange_rate / NULLIF(oil_price, 0)",
    "sentiment_score_rolling_mean": full("AVG", "sentiment", 7),
    "month_sin": "sin(2 * pi() * month(date) / 12)", "weekday": "CAST(isodow(date) AS INTEGER)",
}


FRAME_CTES = _SRC + ", fx AS (SELECT series, date, " + ", ".join(f"{e} AS {n}" for n, e in _EXPR.items()) + " FROM av)"


def last_known(c: str) -> str:
    return f"LAST_VALUE({c} IGNORE NULLS) {_FF}"


@query("feature_frame", f"WITH {MARKET_CTE}, {FRAME_CTES} SELECT " + sql_rounded([*SD, *[f"{last_known(c)} AS {c}" for c in _FRAME["plain"]]],
                                           {c: last_known(c) for c in _FRAME["four"]}, {c: last_known(c) for c in _FRAME["six"]}) + " FROM fx")
def _feature_frame(spark, sf):
    out = create_features(raw_market(spark, sf), SPEC, START, END)
    return rounded(out, [*SD, *_FRAME["plain"]], _FRAME["four"], _FRAME["six"])


_LAG1 = f"rl AS (SELECT *, LAG(official_rate) {W} AS official_rate_lag_1 FROM rates)"
_VEC = ["official_rate", "parallel_rate", "official_rate_lag_1"]


def vectors(spark, sf):
    return pack_features(merge_blocks(win.lag_features(daily_rates(spark, sf), ["official_rate"], (1,), **BY)), _VEC)


_NN = " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in _VEC)


@query("feature_vector_pack", f"""WITH {RATES_CTE}, {_LAG1} SELECT series, date, CAST({_NN} AS INTEGER) AS feature_count,
  {_NN} = 3 AS is_complete, 1.0::DOUBLE AS quality_score, '1.0.0' AS feature_version, parallel_rate FROM rl""")
def _pack(spark, sf):
    v = vectors(spark, sf)
    return v.select(*SD, "feature_count", "is_complete", "quality_score", "feature_version",
                    F.try_element_at("feature_vector", F.lit("parallel_rate")).alias("parallel_rate"))


@query("feature_vector_unpack", f"""WITH {RATES_CTE}, {_LAG1} SELECT series, date, {', '.join(_VEC)} FROM rl
  WHERE date BETWEEN DATE '{ORDERS_AS_OF}' - INTERVAL 400 DAY AND DATE '{ORDERS_AS_OF}'""")
def _unpack(spark, sf):
    return latest_features(vectors(spark, sf), 400, as_of=ORDERS_AS_OF)


@query("naive_forecast", f"""WITH {DAILY_CTE}, m AS (SELECT series, MAX(date) AS prediction_date, arg_max(price, date) AS latest FROM daily GROUP BY 1),
  p AS (SELECT *, latest + h * 0.5::DOUBLE AS p FROM m, (SELECT unnest([1, 2, 3, 4, 5]) AS h))
  SELECT series, prediction_date, h AS horizon, round(p, 2) AS point_forecast, round(p * (1 - 0.02::DOUBLE), 2) AS lower_bound,
    round(p * (1 + 0.02::DOUBLE), 2) AS upper_bound, 0.8::DOUBLE AS confidence, 'drift-1.0' AS model_version FROM p""")
def _forecast(spark, sf):
    return fct.naive_forecast(daily_prices(spark, sf), "price", **BY)


# Each event asks for a forecast k days ahead.
@query("forecast_requests", """WITH r AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) % 8 AS horizon FROM events)
  SELECT event_id, horizon, horizon BETWEEN 1 AND 5 AS is_valid, CASE WHEN horizon BETWEEN 1 AND 5 THEN NULL ELSE 'horizon must be 1 to 5' END AS error FROM r""")
def _requests(spark, sf):
    ev = table(spark, sf, "events").select("event_id", (F.get_json_object("props", "$.k").cast("int") % 8).alias("horizon"))
    return fct.forecast_requests(ev)


COEFS = {"official_rate": 0.45, "parallel_rate": 0.23, "rate_gap": -0.18}


@query("top_contributions", f"""WITH {RATES_CTE}, g AS (SELECT *, parallel_rate - official_rate AS rate_gap FROM rates),
  m AS (SELECT series, {', '.join(f'AVG({c}) AS m_{c}' for c in COEFS)} FROM g GROUP BY 1),
  l AS ({' UNION ALL '.join(f"SELECT series, date, '{c}' AS feature, ({c} - m_{c}) * {w}::DOUBLE AS contribution FROM g JOIN m USING (series)" for c, w in COEFS.items())}),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series, date ORDER BY abs(contribution) DESC, feature) AS rank FROM l WHERE contribution IS NOT NULL)
  SELECT series, date, feature, {s4('contribution')} AS contribution, rank, CASE WHEN contribution < 0 THEN 'negative' ELSE 'positive' END AS direction
  FROM r WHERE rank <= 2""")
def _contributions(spark, sf):
    df = daily_rates(spark, sf).withColumn("rate_gap", F.col("parallel_rate") - F.col("official_rate"))
    out = fct.top_contributions(df, COEFS, 2, **BY)
    return out.select(*SD, "feature", r4("contribution").alias("contribution"), F.col("rank").cast("bigint").alias("rank"), "direction")


# Messages are phrases chosen by event type, with the user's text case mixed in.
_PHRASES = {"click": "What is the FORECAST for tomorrow?", "error": "Why did the rate change?", "purchase": "prediction for next week please",
            "signup": "Help me", "view": "show the dashboard"}
_PHRASE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PHRASES.items()) + " END"


@query("message_intent", f"""WITH m AS (SELECT event_id, lower(concat({_PHRASE_SQL}, ' ', user_id)) AS t FROM events)
  SELECT event_id, CASE WHEN t LIKE '%forecast%' OR t LIKE '%prediction%' THEN 'forecast' WHEN t LIKE '%why%' OR t LIKE '%explain%' THEN 'explain'
    WHEN t LIKE '%help%' THEN 'help' ELSE 'other' END AS intent,
  CASE WHEN t LIKE '%forecast%' OR t LIKE '%prediction%' THEN CASE WHEN t LIKE '%week%' THEN 5 ELSE 1 END END AS horizon FROM m""")
def _intent(spark, sf):
    phrase = F.lit(None).cast("string")
    for k, v in _PHRASES.items():
        phrase = F.when(F.col("event_type") == k, v).otherwise(phrase)
    ev = table(spark, sf, "events").select("event_id", F.concat_ws(" ", phrase, F.col("user_id").cast("string")).alias("text"))
    return message_intent(ev, "text").drop("text")


@query("conversation_intent", """WITH m AS (SELECT conv_id, turn, lower(text) AS t FROM conversations)
  SELECT conv_id, turn, CASE WHEN t LIKE '%forecast%' OR t LIKE '%prediction%' THEN 'forecast' WHEN t LIKE '%why%' OR t LIKE '%explain%' THEN 'explain'
    WHEN t LIKE '%help%' THEN 'help' ELSE 'other' END AS intent,
  CASE WHEN t LIKE '%forecast%' OR t LIKE '%prediction%' THEN CASE WHEN t LIKE '%week%' THEN 5 ELSE 1 END END AS horizon FROM m""")
def _conversation_intent(spark, sf):
    return message_intent(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text").drop("text")


@query("horizon_labels", f"""WITH {DAILY_CTE} SELECT series, date, price, {', '.join(f'LEAD(price, {h}) {W} AS price_t_plus_{h}' for h in range(1, 6))} FROM daily""")
def _labels(spark, sf):
    return merge_blocks(fct.horizon_labels(daily_prices(spark, sf), "price", **BY))


@query("temporal_split", f"""WITH {DAILY_CTE}, r AS (SELECT *, PERCENT_RANK() {W} AS pr FROM daily)
  SELECT series, date, CASE WHEN pr < 1 - 0.2::DOUBLE - 0.1::DOUBLE THEN 'train' WHEN pr < 1 - 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split FROM r""")
def _split(spark, sf):
    return fct.temporal_split(daily_prices(spark, sf), **BY).select(*SD, "split")


@query("champion_model", f"""WITH m AS (SELECT CAST(p_size % 5 + 1 AS INTEGER) AS horizon, p_retailprice AS accuracy_score, p_name AS model_name,
    p_brand AS model_version, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * p_partkey AS training_date FROM part),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY horizon ORDER BY accuracy_score DESC, training_date DESC, model_name DESC, model_version DESC) AS rn FROM m)
  SELECT horizon, accuracy_score, model_name, model_version, {s6("(epoch_us(TIMESTAMP '2024-01-03') - epoch_us(training_date)) / 3.6e9::DOUBLE")} AS hours_old,
    (epoch_us(TIMESTAMP '2024-01-03') - epoch_us(training_date)) / 3.6e9::DOUBLE > 48 AS is_stale FROM r WHERE rn = 1""")
def _champion(spark, sf):
    start = F.to_timestamp(F.lit("2024-01-01"))
    m = table(spark, sf, "part").select(
        (F.col("p_size") % 5 + 1).alias("horizon"), F.col("p_retailprice").alias("accuracy_score"), F.col("p_name").alias("model_name"),
        F.col("p_brand").alias("model_version"), (start + F.make_dt_interval(mins=F.col("p_partkey").cast("int"))).alias("training_date"))
    return fct.champion_model(m, "2024-01-03").select(
        "horizon", "accuracy_score", "model_name", "model_version", r6("hours_old").alias("hours_old"), "is_stale")


@query("horizon_regression", f"""WITH {DAILY_CTE}, l AS (SELECT price AS x, {', '.join(f'LEAD(price, {h}) {W} AS y{h}' for h in (1, 3, 5))} FROM daily),
  u AS ({' UNION ALL '.join(f'SELECT {h} AS horizon, x, y{h} AS y FROM l WHERE y{h} IS NOT NULL' for h in (1, 3, 5))})
  SELECT horizon, COUNT(*) AS rows, round(regr_slope(y, x) + 0.0000123457::DOUBLE, 4) AS coef_price, round(regr_r2(y, x) + 0.0000123457::DOUBLE, 4) AS r2,
    round(regr_intercept(y, x) + 0.00123457::DOUBLE, 2) AS intercept FROM u GROUP BY 1""")
def _regression(spark, sf):
    out = fct.horizon_regression(daily_prices(spark, sf), ["price"], "price", (1, 3, 5), **BY)
    return out.select("horizon", "rows", r4("coef_price").alias("coef_price"), r4("r2").alias("r2"),
                      F.round(F.col("intercept") + F.lit(0.00123457), 2).alias("intercept"))


# Two features; fitted on the oldest 70 % of each series, scored on the newest 10 %.
@query("horizon_regression_held_out", f"""WITH {DAILY_CTE}, l AS (SELECT series, date, price AS x1, LAG(price) {W} AS x2, PERCENT_RANK() {W} AS pr,
    {', '.join(f'LEAD(price, {h}) {W} AS y{h}' for h in (1, 2, 5))} FROM daily),
  u AS ({' UNION ALL '.join(f'SELECT {h} AS horizon, pr, x1, x2, y{h} AS y FROM l WHERE x2 IS NOT NULL AND y{h} IS NOT NULL' for h in (1, 2, 5))}),
  f AS (SELECT horizon, COUNT(*) AS n, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, var_pop(x1) AS v1, var_pop(x2) AS v2,
    covar_pop(x1, x2) AS c12, AVG(x1) AS m1, AVG(x2) AS m2, AVG(y) AS my FROM u WHERE pr < 1 - 0.2::DOUBLE - 0.1::DOUBLE GROUP BY 1),
  b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM f),
  e AS (SELECT horizon, n, b1, b2, my - b1 * m1 - b2 * m2 AS b0, y, y - (my + b1 * (x1 - m1) + b2 * (x2 - m2)) AS off
    FROM u JOIN b USING (horizon) WHERE NOT pr < 1 - 0.1::DOUBLE)
  SELECT horizon, n AS rows, COUNT(*) AS test_rows, round(sqrt(AVG(off * off)) + 0.00123457::DOUBLE, 2) AS rmse,
    round(1 - AVG(off * off) / var_pop(y) + 0.0000123457::DOUBLE, 4) AS r2, round(b0 + 0.00123457::DOUBLE, 2) AS intercept,
    round(b1 + 0.0000123457::DOUBLE, 4) AS coef_price, round(b2 + 0.0000123457::DOUBLE, 4) AS coef_price_lag_1 FROM e GROUP BY horizon, n, b0, b1, b2""")
def _regression_held_out(spark, sf):
    parts = fct.temporal_split(daily_prices(spark, sf), **BY)
    df = win.lag_features(parts, ["price"], (1,), **BY)
    out = fct.horizon_regression(df, ["price", "price_lag_1"], "price", (1, 2, 5), train=F.col("split") == "train", test=F.col("split") == "test", **BY)
    two = [F.round(F.col(c) + F.lit(0.00123457), 2).alias(c) for c in ("rmse", "intercept")]
    return out.select("horizon", "rows", "test_rows", *two, *[r4(c).alias(c) for c in ("r2", "coef_price", "coef_price_lag_1")])


@query("latest_predictions", """WITH p AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS prediction_date, o_orderkey % 5 + 1 AS horizon,
    o_totalprice AS point_forecast, CAST(o_orderkey AS VARCHAR) AS model_version, o_orderstatus AS model_name FROM orders),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series, prediction_date, horizon ORDER BY list_transform(regexp_extract_all(model_version, '[0-9]+'), lambda x: CAST(x AS HUGEINT)) DESC, model_version DESC, model_name DESC) AS rn FROM p)
  SELECT series, prediction_date, horizon, point_forecast, model_version, model_name FROM r WHERE rn = 1""")
def _predictions(spark, sf):
    p = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("prediction_date"), (F.col("o_orderkey") % 5 + 1).alias("horizon"),
        F.col("o_totalprice").alias("point_forecast"), F.col("o_orderkey").cast("string").alias("model_version"), F.col("o_orderstatus").alias("model_name"))
    return latest_predictions(p)
