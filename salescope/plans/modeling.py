"""Model queries: daily features, forecasting, segmentation, outliers.

Deterministic pieces (feature table, split, scaling, metrics, z-scores,
forecast insight rules) have SQL oracles; fitted models (trees, k-means,
isolation forest) are checked by row count / schema here and by invariants
in the unit tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..models import anomaly, forecast, linear, segment, training
from ..operators import report
from ..operators.features import DAILY_FEATURES, daily_features
from ..session import scratch_path, store
from .registry import query, rnd, view, with_sales

KEYS = ["order_id", "line_no", "part_id", "supplier_id"]
KEYS_SQL = "order_id, line_no, part_id, supplier_id"

_DAILY_SQL = """
, d AS (SELECT CAST(CAST(date AS DATE) AS TIMESTAMP) AS date, sum(revenue) AS revenue FROM sales
        WHERE date IS NOT NULL GROUP BY 1)
, f AS (SELECT date, revenue, year(date) AS year, month(date) AS month, quarter(date) AS quarter,
               isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, weekofyear(date) AS week_of_year,
               CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
               lag(revenue, 1) OVER w AS lag_1, lag(revenue, 7) OVER w AS lag_7,
               lag(revenue, 14) OVER w AS lag_14, lag(revenue, 30) OVER w AS lag_30,
               avg(revenue) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7,
               avg(revenue) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS rolling_14,
               avg(revenue) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS rolling_30,
               coalesce(stddev_samp(revenue) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS rolling_std7,
               CASE WHEN count(revenue) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) >= 2
                    THEN regr_slope(revenue, rn) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) ELSE 0 END AS trend_7
        FROM (SELECT *, CAST(row_number() OVER (ORDER BY date) AS DOUBLE) AS rn FROM d)
        WINDOW w AS (ORDER BY date))
, daily AS (SELECT * FROM f WHERE lag_1 IS NOT NULL)
"""

_FLOAT_FEATURES = ["lag_1", "lag_7", "lag_14", "lag_30", "rolling_7", "rolling_14", "rolling_30",
                   "rolling_std7", "trend_7"]


def _daily(spark, d):
    return daily_features(view(spark, d, "date", "revenue"))


@query("daily_features", with_sales(_DAILY_SQL + """
SELECT date, round(revenue, 4) AS revenue, year, month, quarter, day_of_week, day_of_month, week_of_year, is_weekend,
       """ + ", ".join(f"round({c}, 6) AS {c}" for c in _FLOAT_FEATURES) + """
FROM daily
"""))
def q_daily_features(spark, d):
    return rnd(_daily(spark, d), ["revenue"], _FLOAT_FEATURES)


@query("fc_split", with_sales(_DAILY_SQL + """
SELECT date, round(revenue, 4) AS revenue,
       CASE WHEN row_number() OVER (ORDER BY date) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
FROM daily
"""))
def q_fc_split(spark, d):
    out = forecast.split_train_test(_daily(spark, d), 0.2)
    return rnd(out.select("date", "revenue", "split"), ["revenue"])


def _scale_sql() -> str:
    qs = ", ".join(f"quantile_cont(coalesce({c}, 0), [0.25, 0.5, 0.75]) AS q_{c}" for c in DAILY_FEATURES)
    cols = []
    for c in DAILY_FEATURES:
        iqr = f"(q_{c}[3] - q_{c}[1])"
        cols.append(f"round((coalesce({c}, 0) - q_{c}[2]) / CASE WHEN {iqr} = 0 THEN 1 ELSE {iqr} END, 6) AS {c}")
    return with_sales(_DAILY_SQL + f"""
, s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY date) <= floor(count(*) OVER () * 0.8)
                       THEN 'train' ELSE 'test' END AS split FROM daily)
, q AS (SELECT {qs} FROM s WHERE split = 'train')
SELECT date, split, {", ".join(cols)} FROM s, q
""")


@query("fc_scale", _scale_sql())
def q_fc_scale(spark, d):
    split = forecast.split_train_test(_daily(spark, d), 0.2)
    stats = forecast.fit_scaler(split.where(F.col("split") == "train"), DAILY_FEATURES)
    scaled = split.select("date", "split", *[
        ((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c)
        for c in DAILY_FEATURES])
    return rnd(scaled, [], DAILY_FEATURES)


@query("fc_metrics", with_sales(_DAILY_SQL + """
, s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY date) <= floor(count(*) OVER () * 0.8)
                       THEN 'train' ELSE 'test' END AS split FROM daily)
SELECT split, round(avg(abs(revenue - lag_1)), 6) AS mae, round(sqrt(avg((revenue - lag_1) * (revenue - lag_1))), 6) AS rmse,
       round(avg(abs(revenue - lag_1) / greatest(abs(revenue), 2.220446049250313e-16)) * 100, 6) AS mape,
       round(CASE WHEN var_pop(revenue) * count(revenue) <> 0
                  THEN 1 - sum((revenue - lag_1) * (revenue - lag_1)) / (var_pop(revenue) * count(revenue))
                  WHEN sum((revenue - lag_1) * (revenue - lag_1)) = 0 THEN 1 ELSE 0 END, 6) AS r2
FROM s GROUP BY split
"""))
def q_fc_metrics(spark, d):
    """Metrics of the naive forecast (yesterday's revenue) per split."""
    split = forecast.split_train_test(_daily(spark, d), 0.2)
    out = forecast.regression_metrics(split, "revenue", "lag_1", by="split")
    return rnd(out, [], ["mae", "rmse", "mape", "r2"])


def _fit(spark, d, model_type, tuning=False):
    fc, scored = forecast.fit_forecaster(view(spark, d, "date", "revenue"), model_type, 0.2, tuning)
    return fc, scored


def _linear_sql(alpha: float, missing: tuple = (), series: str | None = None) -> str:
    """Predictions of least squares (alpha 0) or ridge: the scaled features,
    the centred Gram matrix of the training rows, Gauss-Jordan elimination as a
    recursive query, and the linear form on every day; ``missing`` features
    count as 0 when predicting.  ``series`` names a column whose values have a
    day table each, pooled in one model."""
    by = f"PARTITION BY {series} " if series else ""
    daily = _DAILY_SQL
    if series:
        daily = (daily.replace("AS date, sum(revenue)", f"AS date, {series}, sum(revenue)").replace("GROUP BY 1)", "GROUP BY 1, 2)")
                 .replace("SELECT date, revenue,", f"SELECT date, {series}, revenue,").replace("OVER (ORDER BY date)", f"OVER ({by}ORDER BY date)")
                 .replace("WINDOW w AS (ORDER BY date)", f"WINDOW w AS ({by}ORDER BY date)"))
    p = len(DAILY_FEATURES)
    iqr = {c: f"CASE WHEN q_{c}[3] = q_{c}[1] THEN 1 ELSE q_{c}[3] - q_{c}[1] END" for c in DAILY_FEATURES}
    scaled = ", ".join(f"(coalesce({c}, 0) - q_{c}[2]) / {iqr[c]}" for c in DAILY_FEATURES)
    given = ", ".join(f"({0 if c in missing else f'coalesce({c}, 0)'} - q_{c}[2]) / {iqr[c]}" for c in DAILY_FEATURES)
    qs = ", ".join(f"quantile_cont(coalesce({c}, 0), [0.25, 0.5, 0.75]) AS q_{c}" for c in DAILY_FEATURES)
    sql = with_sales(daily + f"""
, s AS (SELECT *, CASE WHEN row_number() OVER ({by}ORDER BY date) <= floor(count(*) OVER ({by}) * 0.8)
                       THEN 'train' ELSE 'test' END AS split FROM daily)
, q AS (SELECT {qs} FROM s WHERE split = 'train')
, z AS MATERIALIZED (SELECT date, split, revenue, [{scaled}] AS x, [{given}] AS u FROM s, q)
, i AS (SELECT unnest(range(1, {p + 1})) AS i)
, j AS (SELECT unnest(range(1, {p + 2})) AS j)
, mean AS MATERIALIZED (SELECT list(v ORDER BY i) AS mx, any_value(my) AS my
    FROM (SELECT i, avg(x[i]) AS v, avg(revenue) AS my FROM z, i WHERE split = 'train' GROUP BY i))
, c AS MATERIALIZED (SELECT list_append(list_transform(range(1, {p + 1}), lambda k: x[k] - mx[k]), revenue - my) AS c
    FROM z, mean WHERE split = 'train')
, g AS (SELECT i, j, sum(c[i] * c[j]) + CASE WHEN i = j THEN {alpha} ELSE 0 END AS v FROM c, i, j GROUP BY i, j)
, ge AS (SELECT 1 AS k, list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM g GROUP BY i)
    UNION ALL
    SELECT k + 1, list_transform(range(1, {p + 1}), lambda a:
        CASE WHEN a = k THEN list_transform(m[k], lambda v: v / m[k][k])
             ELSE list_transform(range(1, {p + 2}), lambda b: m[a][b] - m[a][k] * m[k][b] / m[k][k]) END)
    FROM ge WHERE k <= {p})
, beta AS (SELECT list_transform(m, lambda r: r[{p + 1}]) AS b FROM ge WHERE k = {p + 1})
, fitted AS (SELECT date, split, revenue, my + list_sum(list_transform(range(1, {p + 1}), lambda k: b[k] * (u[k] - mx[k]))) AS prediction
    FROM z, mean, beta)
""" + "SELECT * FROM fitted")
    return sql.replace("WITH sales", "WITH RECURSIVE sales", 1)


def _panel_sql() -> str:
    """The recursive forecast of every region: the state is a list of its last
    30 days, the features of the next day come from it, and the prediction
    (not below 0) is appended."""
    last = lambda k: f"h[greatest(len(h) - {k - 1}, 1):len(h)]"
    lag = lambda k: f"CASE WHEN len(h) >= {k} THEN h[len(h) - {k - 1}] ELSE list_avg(h) END"
    m, xs = f"len({last(7)})", f"range(0, len({last(7)}))"
    sxy = f"list_sum(list_transform({xs}, lambda x: x * ({last(7)})[x + 1]))"
    features = {
        "year": "year(nd)", "month": "month(nd)", "quarter": "quarter(nd)", "day_of_week": "isodow(nd) - 1", "day_of_month": "day(nd)",
        "week_of_year": "weekofyear(nd)", "is_weekend": "CASE WHEN isodow(nd) >= 6 THEN 1 ELSE 0 END",
        **{f"lag_{k}": lag(k) for k in (1, 7, 14, 30)}, **{f"rolling_{k}": f"list_avg({last(k)})" for k in (7, 14, 30)},
        "rolling_std7": f"CASE WHEN {m} > 1 THEN list_stddev_pop({last(7)}) ELSE 0 END",
        "trend_7": f"CASE WHEN {m} >= 2 THEN ({m} * {sxy} - list_sum({xs}) * list_sum({last(7)})) / "
                   f"({m} * list_sum(list_transform({xs}, lambda x: x * x)) - list_sum({xs}) * list_sum({xs})) ELSE 0 END"}
    scaled = ", ".join(f"(({features[c]}) - q_{c}[2]) / CASE WHEN q_{c}[3] = q_{c}[1] THEN 1 ELSE q_{c}[3] - q_{c}[1] END"
                       for c in DAILY_FEATURES)
    return _linear_sql(0, series="region").replace("SELECT * FROM fitted", f"""
, start AS (SELECT region, max(date) AS last, list(revenue ORDER BY date) AS h
    FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC) AS r FROM daily) WHERE r <= 30 GROUP BY region)
, walk AS (SELECT region, last, 0 AS i, h, CAST(NULL AS TIMESTAMP) AS date, CAST(NULL AS DOUBLE) AS forecast FROM start
    UNION ALL
    SELECT region, last, i + 1, list_append(h, f)[greatest(len(h) - 28, 1):], nd, f
    FROM (SELECT region, last, i, h, nd, greatest(0, my + list_sum(list_transform(range(1, {len(DAILY_FEATURES) + 1}),
                 lambda k: b[k] * (u[k] - mx[k])))) AS f
          FROM (SELECT region, last, i, h, nd, [{scaled}] AS u
                FROM (SELECT region, last, i, h, last + to_days(i + 1) AS nd FROM walk WHERE i < 30), q), beta, mean))
SELECT region, date, round(forecast, 2) AS forecast FROM walk WHERE i > 0
""")


def _whole(sql: str, cols: str) -> str:
    """Predictions to the unit (sums in another order differ in late digits)."""
    return sql.replace("SELECT * FROM fitted", f"SELECT {cols}, round(revenue, 4) AS revenue, round(prediction, 0) AS prediction FROM fitted")


def _to_units(df):
    return rnd(df, ["revenue"]).withColumn("prediction", F.round("prediction", 0))


def _model_query(model_type):
    def run(spark, d):
        _, scored = _fit(spark, d, model_type)
        out = scored.select("date", "split", "revenue", "prediction")
        return _to_units(out) if model_type in linear.KINDS else out
    run.__doc__ = f"Fit the {model_type} forecaster; predictions for train and test days."
    return run


for _mt, _alpha in [("linear", 0), ("ridge", 1)]:
    query(f"fc_{_mt}", _whole(_linear_sql(_alpha), "date, split"))(_model_query(_mt))
for _mt in ["lasso", "random_forest", "gradient_boosting", "xgboost", "lightgbm", "ensemble", "stacking"]:
    query(f"fc_{_mt}")(_model_query(_mt))


@query("fc_tuning")
def q_fc_tuning(spark, d):
    """Random-forest grid search on expanding time folds; the chosen
    parameters and the test metrics of the refitted model."""
    fc, _ = _fit(spark, d, "random_forest", tuning=True)
    best = fc.model._salescope_best
    return spark.createDataFrame([(best["numTrees"], best["maxDepth"], best["minInstancesPerNode"],
                                   fc.metrics.get("test_rmse"), fc.metrics.get("test_r2"))],
                                 "num_trees int, max_depth int, min_instances_per_node int, test_rmse double, test_r2 double")


_MISSING = ("trend_7", "rolling_std7")


@query("fc_predict", _whole(_linear_sql(0, _MISSING), "date"))
def q_fc_predict(spark, d):
    """Predict from feature rows where some features are missing (→ 0)."""
    fc, _ = _fit(spark, d, "linear")
    return _to_units(fc.transform(_daily(spark, d).drop(*_MISSING)).select("date", "revenue", "prediction"))


@query("fc_future")
def q_fc_future(spark, d):
    """30-day recursive forecast of total daily revenue."""
    fc, _ = _fit(spark, d, "random_forest")
    return forecast.forecast_future(fc, view(spark, d, "date", "revenue"), 30)


@query("fc_future_panel", _panel_sql())
def q_fc_future_panel(spark, d):
    """30-day recursive forecast for every region at once (one pooled model;
    every series keeps its own 30-day history)."""
    sales = view(spark, d, "date", "region", "revenue")
    fc, _ = forecast.fit_forecaster(sales, "linear", 0.2, series=["region"])
    out = forecast.forecast_future(fc, sales, 30)
    return out.withColumn("forecast", F.round("forecast", 2))


@query("fc_importance")
def q_fc_importance(spark, d):
    fc, _ = _fit(spark, d, "random_forest")
    return fc.feature_importance()


_FC_INPUT_SQL = _DAILY_SQL + """
, ranked AS (SELECT date, revenue, row_number() OVER (ORDER BY date DESC) AS r FROM d)
, fc AS (SELECT date, revenue AS forecast, row_number() OVER (ORDER BY date) - 1 AS i FROM ranked WHERE r <= 30)
, hist AS (SELECT date, revenue FROM ranked WHERE r > 30)
, n AS (SELECT count(*) AS n FROM fc)
, wk AS (SELECT weekofyear(date) AS week, avg(forecast) AS wavg FROM fc GROUP BY 1)
, ins0 AS (
  SELECT sum(forecast) AS total_forecast, avg(forecast) AS avg_daily,
         arg_max(date, forecast * 1e6 - i) AS max_day, max(forecast) AS max_forecast,
         arg_min(date, forecast * 1e6 + i) AS min_day, min(forecast) AS min_forecast,
         avg(CASE WHEN isodow(date) >= 6 THEN forecast END) AS avg_weekend,
         avg(CASE WHEN isodow(date) < 6 THEN forecast END) AS avg_weekday,
         stddev_samp(forecast) AS sd, count(*) AS n_periods,
         avg(CASE WHEN i < floor((SELECT n FROM n) / 2) THEN forecast END) AS a,
         avg(CASE WHEN i >= floor((SELECT n FROM n) / 2) THEN forecast END) AS b,
         (SELECT avg(revenue) FROM (SELECT revenue FROM hist ORDER BY date DESC LIMIT (SELECT n FROM n))) AS avg_hist,
         (SELECT week FROM wk ORDER BY wavg, week LIMIT 1) AS worst_week,
         (SELECT min(wavg) FROM wk) AS worst_week_avg
  FROM fc)
, ins AS (
  SELECT *, coalesce(CASE WHEN a = 0 THEN NULL ELSE (b - a) / a * 100 END, 0) AS trend_pct,
         coalesce(CASE WHEN avg_hist = 0 THEN NULL ELSE (avg_daily - avg_hist) / avg_hist * 100 END, 0) AS vs_hist_pct,
         coalesce(CASE WHEN avg_daily = 0 THEN NULL ELSE (worst_week_avg - avg_daily) / avg_daily * 100 END, 0) AS worst_week_drop_pct,
         coalesce(CASE WHEN avg_weekday = 0 THEN NULL ELSE (avg_weekend - avg_weekday) / avg_weekday * 100 END, 0) AS weekend_diff_pct,
         coalesce(CASE WHEN avg_daily = 0 THEN NULL ELSE sd / avg_daily * 100 END, 0) AS volatility_pct
  FROM ins0)
"""


def _fc_input(spark, d):
    """The last 30 observed days as the 'forecast', earlier days as history."""
    from ..operators.features import daily_series
    days = daily_series(view(spark, d, "date", "revenue"))
    r = days.withColumn("_r", F.row_number().over(Window.orderBy(F.col("date").desc())))  # day table: bounded
    fc = r.where(F.col("_r") <= 30).select("date", F.col("revenue").alias("forecast"))
    hist = r.where(F.col("_r") > 30).select("date", "revenue")
    return fc, hist


_INS_MONEY = ["total_forecast", "avg_daily", "max_forecast", "min_forecast", "avg_weekend", "avg_weekday",
              "avg_hist", "worst_week_avg"]
_INS_RATIO = ["trend_pct", "vs_hist_pct", "worst_week_drop_pct", "weekend_diff_pct", "volatility_pct"]


@query("fc_insights", with_sales(_FC_INPUT_SQL + """
SELECT """ + ", ".join(f"round({c}, 4) AS {c}" for c in _INS_MONEY) + ", "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _INS_RATIO) + """,
       max_day, min_day, n_periods, worst_week,
       CASE WHEN trend_pct < -15 OR worst_week_drop_pct < -30 THEN 'HIGH'
            WHEN trend_pct < -5 OR worst_week_drop_pct < -15 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM ins
"""))
def q_fc_insights(spark, d):
    fc, hist = _fc_input(spark, d)
    return rnd(report.forecast_insights(fc, hist), _INS_MONEY, _INS_RATIO)


def _fx(expr: str) -> str:
    return f"printf('%.1f', {expr})"


@query("fc_actions", with_sales(_FC_INPUT_SQL + f"""
, rules AS (
  SELECT 1 AS rule_no, 'URGENT' AS level, 'Sharp downward trend: revenue falls ' || {_fx('abs(trend_pct)')} || '% towards the end of the horizon' AS action FROM ins WHERE trend_pct < -15
  UNION ALL SELECT 1, 'WARNING', 'Moderate decline of ' || {_fx('abs(trend_pct)')} || '% in the second half' FROM ins WHERE trend_pct >= -15 AND trend_pct < -5
  UNION ALL SELECT 1, 'OPPORTUNITY', 'Strong growth of ' || {_fx('trend_pct')} || '% expected' FROM ins WHERE trend_pct >= -5 AND trend_pct > 15
  UNION ALL SELECT 1, 'POSITIVE', 'Growth of ' || {_fx('trend_pct')} || '% detected' FROM ins WHERE trend_pct >= -5 AND trend_pct <= 15 AND trend_pct > 5
  UNION ALL SELECT 2, 'WARNING', 'Possible drop in ISO week ' || CAST(worst_week AS VARCHAR) || ': ' || {_fx('abs(worst_week_drop_pct)')} || '% below the daily mean' FROM ins WHERE worst_week_drop_pct < -20
  UNION ALL SELECT 3, 'PATTERN', 'Weekend revenue ' || {_fx('weekend_diff_pct')} || '% above weekdays' FROM ins WHERE weekend_diff_pct > 20
  UNION ALL SELECT 3, 'PATTERN', 'Weekday revenue ' || {_fx('abs(weekend_diff_pct)')} || '% above weekends' FROM ins WHERE weekend_diff_pct <= 20 AND weekend_diff_pct < -20
  UNION ALL SELECT 4, 'WARNING', 'Extreme day-to-day volatility' FROM ins WHERE volatility_pct > 60
  UNION ALL SELECT 5, 'URGENT', 'Forecast ' || {_fx('abs(vs_hist_pct)')} || '% below the same number of past days' FROM ins WHERE vs_hist_pct < -10
  UNION ALL SELECT 5, 'POSITIVE', 'Forecast ' || {_fx('vs_hist_pct')} || '% above the same number of past days' FROM ins WHERE vs_hist_pct >= -10 AND vs_hist_pct > 10)
SELECT * FROM rules
UNION ALL SELECT 6, 'STABLE', 'No warning signal: keep the current plan and track actuals weekly' WHERE (SELECT count(*) FROM rules) = 0
"""))
def q_fc_actions(spark, d):
    fc, hist = _fc_input(spark, d)
    return report.forecast_actions(report.forecast_insights(fc, hist))


@query("insights", with_sales("""
, tot AS (SELECT sum(revenue) AS rev, count(*) AS n FROM sales)
, m AS (SELECT date_trunc('month', date) AS month, sum(revenue) AS revenue FROM sales WHERE date IS NOT NULL GROUP BY 1)
, mm AS (SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS prev FROM m)
, lastm AS (SELECT CASE WHEN prev = 0 THEN NULL ELSE (revenue - prev) / prev * 100 END AS mom FROM mm ORDER BY month DESC LIMIT 1)
, p AS (SELECT product, sum(revenue) AS revenue FROM sales WHERE product IS NOT NULL GROUP BY product ORDER BY 2 DESC, 1 LIMIT 1)
, pm AS (SELECT date_trunc('month', date) AS month, product, sum(revenue) AS revenue FROM sales
         WHERE date IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2)
, l AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY month DESC) AS rn FROM pm)
, l3 AS (SELECT *, lead(revenue) OVER (PARTITION BY product ORDER BY rn) AS older FROM l WHERE rn <= 3)
, g AS (SELECT product, count(*) AS n, count_if(older IS NOT NULL AND revenue > older) AS ups,
               arg_max(revenue, rn) AS first_rev, arg_min(revenue, rn) AS latest FROM l3 GROUP BY product)
, dec AS (SELECT product, CASE WHEN first_rev = 0 THEN NULL ELSE (first_rev - latest) / first_rev * 100 END AS d
          FROM g WHERE n >= 3 AND ups = 0 ORDER BY d DESC NULLS LAST, product LIMIT 1)
, c AS (SELECT category, sum(revenue) / (SELECT sum(revenue) FROM sales WHERE category IS NOT NULL) * 100 AS pct
        FROM sales WHERE category IS NOT NULL GROUP BY category ORDER BY sum(revenue) DESC, category LIMIT 1)
, wk AS (SELECT avg(CASE WHEN isodow(date) >= 6 THEN revenue END) AS we, avg(CASE WHEN isodow(date) < 6 THEN revenue END) AS wd FROM sales)
SELECT 1 AS line_no, 'Total revenue: Rp ' || format('{:,.0f}', rev) AS text FROM tot
UNION ALL SELECT 2, 'Total transactions: ' || format('{:,}', n) FROM tot
UNION ALL SELECT 3, 'Average order value: Rp ' || format('{:,.0f}', rev / n) FROM tot
UNION ALL SELECT 4, 'Revenue last month ' || CASE WHEN mom > 0 THEN 'up ' ELSE 'down ' END || printf('%.1f', abs(mom)) || '% (MoM)' FROM lastm WHERE mom IS NOT NULL
UNION ALL SELECT 5, 'Top product: ' || product || ' (Rp ' || format('{:,.0f}', revenue) || ')' FROM p
UNION ALL SELECT 6, 'Warning: ' || product || ' fell ' || printf('%.1f', d) || '% over the last 3 months' FROM dec
UNION ALL SELECT 7, 'Largest category: ' || category || ' (' || printf('%.1f', pct) || '% of total revenue)' FROM c
UNION ALL SELECT 8, 'Weekend revenue is ' || printf('%.1f', (we / wd - 1) * 100) || '% higher than weekdays' FROM wk
  WHERE we IS NOT NULL AND wd IS NOT NULL AND wd > 0 AND we > wd
"""))
def q_insights(spark, d):
    return report.insights(view(spark, d, "date", "product", "category", "revenue"))


@query("model_compare")
def q_model_compare(spark, d):
    """Fit every available model; sorted by test RMSE, failures last with
    their error (extra trees has no Spark counterpart)."""
    return training.compare_models(view(spark, d, "date", "revenue"))


@query("model_save_load")
def q_model_save_load(spark, d):
    """Persist a fitted forecaster, load it back and predict with it."""
    fc, scored = _fit(spark, d, "ensemble")
    path = scratch_path(spark, f"forecaster-{uuid.uuid4().hex[:12]}")
    fc.save(path)
    loaded = forecast.Forecaster.load(path)
    again = loaded.transform(_daily(spark, d)).select("date", F.col("prediction").alias("reloaded"))
    return scored.select("date", "prediction").join(again, "date")


# ---------------------------------------------------------------------------
# segmentation
# ---------------------------------------------------------------------------

def _stats(spark, d):
    return segment.product_stats(view(spark, d, "product", "revenue", "quantity", "price"))


_STATS_ROUND = ["total_revenue", "total_quantity"], ["avg_revenue", "avg_quantity", "avg_price"]
_STATS_SQL = """SELECT product, coalesce(sum(revenue), 0) AS total_revenue, avg(revenue) AS avg_revenue, count(revenue) AS transaction_count,
    coalesce(sum(quantity), 0) AS total_quantity, avg(quantity) AS avg_quantity, avg(price) AS avg_price
    FROM {rows} WHERE product IS NOT NULL GROUP BY product"""


def _kmeans_sql(k: int = 4, starts: int = 10, seed: int = 42) -> str:
    """k-means in SQL: the picks of k-means++ as races keyed by md5, the
    iterations of all starts as a recursive query, the best start, and its
    centres in falling order."""
    p = len(segment.SEGMENT_FEATURES)
    names = list(enumerate(segment.SEGMENT_FEATURES, 1))
    means = ", ".join(f"avg(coalesce({c}, 0))" for _, c in names)
    stds = ", ".join(f"CASE WHEN stddev_pop(coalesce({c}, 0)) = 0 THEN 1 ELSE stddev_pop(coalesce({c}, 0)) END" for _, c in names)
    scaled = ", ".join(f"(coalesce({c}, 0) - m[{i}]) / d[{i}]" for i, c in names)
    u = "((('0x' || md5('{seed}:' || s || ':{pick}:' || product)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
    near = "list_min(list_transform(c, lambda e: pow(list_distance(e, x), 2)))"
    own = "list_position(list_transform(c, lambda e: list_distance(e, x)), list_min(list_transform(c, lambda e: list_distance(e, x))))"
    picks = [f"pick0 AS (SELECT s, [arg_min(x, -ln({u.format(seed=seed, pick=0)}))] AS c FROM pt, starts GROUP BY s)"]
    for i in range(1, k):
        picks.append(f"""pick{i} AS (SELECT s, list_append(any_value(c), arg_min(x, -ln({u.format(seed=seed, pick=i)}) / {near})) AS c
    FROM pt, pick{i - 1} WHERE {near} > 0 GROUP BY s)""")
    centre = ", ".join("CASE WHEN count(*) FILTER (j = {0}) > 0 THEN [{1}] ELSE any_value(c)[{0}] END".format(
        j, ", ".join(f"avg(x[{i}]) FILTER (j = {j})" for i in range(1, p + 1))) for j in range(1, k + 1))
    return with_sales(f"""
, st AS MATERIALIZED ({_STATS_SQL.format(rows="sales")})
, sc AS (SELECT [{means}] AS m, [{stds}] AS d FROM st)
, pt AS MATERIALIZED (SELECT product, [{scaled}] AS x FROM st, sc)
, starts AS (SELECT unnest(range(0, {starts})) AS s)
, {", ".join(picks)}
, walk AS (SELECT 0 AS it, s, c FROM pick{k - 1}
    UNION ALL SELECT it + 1, s, [{centre}] FROM (SELECT it, s, c, x, {own} AS j FROM walk, pt WHERE it < {segment.MAX_ITERATIONS}) GROUP BY it, s)
, done AS (SELECT s, c FROM walk WHERE it = {segment.MAX_ITERATIONS})
, best AS (SELECT list_reverse_sort(c) AS c FROM (SELECT s, any_value(c) AS c, sum({near}) AS cost FROM done, pt GROUP BY s) ORDER BY round(cost, 6), s LIMIT 1)
, assigned AS MATERIALIZED (SELECT st.*, pt.x, {own} - 1 AS cluster FROM st JOIN pt USING (product), best)
, profile AS MATERIALIZED (SELECT cluster, {", ".join(f"avg(coalesce({c}, 0)) AS {c}" for _, c in names)} FROM assigned GROUP BY cluster)
, med AS (SELECT quantile_cont(total_revenue, 0.5) AS r, quantile_cont(transaction_count, 0.5) AS t FROM profile)
, named AS MATERIALIZED (SELECT profile.*, CASE WHEN total_revenue > r AND transaction_count > t THEN '{fixed.SEGMENT_STAR}'
    WHEN total_revenue > r THEN '{fixed.SEGMENT_PREMIUM}' WHEN transaction_count > t THEN '{fixed.SEGMENT_VOLUME}' ELSE '{fixed.SEGMENT_LOW}' END AS segment
    FROM profile, med)
""" + "SELECT * FROM named").replace("WITH sales", "WITH RECURSIVE sales", 1)


_ROUNDED = ", ".join(f"round({c}, {4 if c in _STATS_ROUND[0] else 6}) AS {c}" for c in segment.SEGMENT_FEATURES if c != "transaction_count")


def _seg_sql(last: str) -> str:
    return _kmeans_sql().replace("SELECT * FROM named", last)


@query("seg_fit", _seg_sql(f"""SELECT product, {_ROUNDED.replace("(", "(a.")}, a.transaction_count, a.cluster, segment
FROM assigned a JOIN named USING (cluster)"""))
def q_seg_fit(spark, d):
    """k-means (k = 4, best of 10 starts) on standardised product stats."""
    stats = _stats(spark, d)
    return rnd(segment.assign_segments(segment.fit_segments(stats), stats), *_STATS_ROUND)


@query("seg_profiles", _seg_sql(f"SELECT cluster, {_ROUNDED}, round(transaction_count, 6) AS transaction_count, segment FROM named"))
def q_seg_profiles(spark, d):
    stats = _stats(spark, d)
    model = segment.fit_segments(stats)
    assigned = model.transform(segment._filled(stats))
    return rnd(segment.segment_names(segment.cluster_profiles(assigned)), _STATS_ROUND[0], [*_STATS_ROUND[1], "transaction_count"])


@query("seg_silhouette", _seg_sql("""
, far AS (SELECT a.product, a.cluster AS own, b.cluster AS c, sum(pow(list_distance(a.x, b.x), 2)) AS total, count(*) AS n
    FROM assigned a, assigned b GROUP BY 1, 2, 3)
, two AS (SELECT product, max(CASE WHEN c = own AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN c <> own THEN total / n END) AS b
    FROM far GROUP BY product)
SELECT round(avg(coalesce(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 0)), 6) AS silhouette FROM two
"""))
def q_seg_silhouette(spark, d):
    stats = _stats(spark, d)
    model = segment.fit_segments(stats)
    return rnd(spark.createDataFrame([(segment.silhouette(model, stats),)], "silhouette double"), [], ["silhouette"])


@query("seg_predict", _seg_sql(f"""
, recent AS ({_STATS_SQL.format(rows="sales JOIN (SELECT max(date) - INTERVAL 365 DAY AS cut FROM sales) ON date > cut")})
, placed AS (SELECT recent.*, list_position(list_transform(c, lambda e: list_distance(e, x)), list_min(list_transform(c, lambda e: list_distance(e, x)))) - 1 AS cluster
    FROM (SELECT recent.*, [{", ".join(f"(coalesce({c}, 0) - m[{i}]) / d[{i}]" for i, c in enumerate(segment.SEGMENT_FEATURES, 1))}] AS x FROM recent, sc) recent, best)
SELECT product, {_ROUNDED.replace("(", "(a.")}, a.transaction_count, a.cluster, segment FROM placed a LEFT JOIN named USING (cluster)"""))
def q_seg_predict(spark, d):
    """Assign the products' statistics of the latest year to the segments
    fitted on all data."""
    v = view(spark, d, "date", "product", "revenue", "quantity", "price")
    stats = segment.product_stats(v)
    model = segment.fit_segments(stats)
    names = segment.segment_names(segment.cluster_profiles(model.transform(segment._filled(stats))))
    latest = v.agg(F.max("date")).scalar()
    recent = segment.product_stats(v.where(F.col("date") > latest - F.make_dt_interval(F.lit(365))))
    return rnd(segment.assign_segments(model, recent, names), *_STATS_ROUND)


@query("segment_summary", _seg_sql("""SELECT segment, count(*) AS products, round(sum(a.total_revenue), 4) AS total_revenue
FROM assigned a JOIN named USING (cluster) GROUP BY segment"""))
def q_segment_summary(spark, d):
    stats = _stats(spark, d)
    model = segment.fit_segments(stats)
    return rnd(segment.segment_summary(segment.assign_segments(model, stats)), ["total_revenue"])


# ---------------------------------------------------------------------------
# outliers
# ---------------------------------------------------------------------------

_Z_SQL = f"""
, x AS (SELECT {KEYS_SQL}, coalesce(revenue, 0) AS r, coalesce(quantity, 0) AS q FROM sales)
, s AS (SELECT avg(r) AS mr, stddev_samp(r) AS sr, avg(q) AS mq, stddev_samp(q) AS sq FROM x)
, z AS (SELECT {KEYS_SQL}, CASE WHEN sr = 0 THEN NULL ELSE abs(r - mr) / sr END AS zr,
               CASE WHEN sq = 0 THEN NULL ELSE abs(q - mq) / sq END AS zq FROM x, s)
, scored AS (SELECT {KEYS_SQL}, coalesce(CAST(greatest(zr, zq) > 3 AS INTEGER), 0) AS anomaly,
                    greatest(zr, zq) AS anomaly_score FROM z)
"""


@query("anom_zscore", with_sales(_Z_SQL + f"""
SELECT {KEYS_SQL}, anomaly, round(anomaly_score, 6) AS anomaly_score FROM scored
"""))
def q_anom_zscore(spark, d):
    out = anomaly.zscore(view(spark, d, *KEYS, "revenue", "quantity"))
    return rnd(out.select(*KEYS, "anomaly", "anomaly_score"), [], ["anomaly_score"])


@query("anom_zscore_new", with_sales(_Z_SQL.replace(
    "FROM sales)", "FROM sales WHERE date > (SELECT max(date) FROM sales) - INTERVAL 365 DAY)", 1) + f"""
SELECT {KEYS_SQL}, anomaly, round(anomaly_score, 6) AS anomaly_score FROM scored
"""))
def q_anom_zscore_new(spark, d):
    """Score the latest year as new data: statistics come from the new rows."""
    v = view(spark, d, *KEYS, "date", "revenue", "quantity")
    latest = v.agg(F.max("date")).scalar()
    new = v.where(F.col("date") > latest - F.make_dt_interval(F.lit(365)))
    out = anomaly.zscore(new)
    return rnd(out.select(*KEYS, "anomaly", "anomaly_score"), [], ["anomaly_score"])


@query("anom_summary", with_sales(_Z_SQL + """
SELECT count(*) AS rows, sum(anomaly) AS anomalies, round(sum(anomaly) * 100.0 / count(*), 6) AS anomaly_rate_pct
FROM scored
"""))
def q_anom_summary(spark, d):
    out = anomaly.anomaly_summary(anomaly.zscore(view(spark, d, *KEYS, "revenue", "quantity")))
    return rnd(out.withColumn("anomalies", F.col("anomalies").cast("long")), [], ["anomaly_rate_pct"])


@query("anomalies_only", with_sales(_Z_SQL + f"""
SELECT {KEYS_SQL}, anomaly, round(anomaly_score, 6) AS anomaly_score FROM scored WHERE anomaly = 1
"""))
def q_anomalies_only(spark, d):
    out = anomaly.anomalies_only(anomaly.zscore(view(spark, d, *KEYS, "revenue", "quantity")))
    return rnd(out.select(*KEYS, "anomaly", "anomaly_score"), [], ["anomaly_score"])


@query("anom_iforest")
def q_anom_iforest(spark, d):
    """Isolation forest (100 trees, 256-row samples, 5 % contamination)."""
    out = anomaly.isolation_forest(view(spark, d, *KEYS, "date", "revenue", "quantity"))
    return out.select(*KEYS, "date", "revenue", "quantity", "anomaly", "anomaly_score")


@query("anom_iforest_new")
def q_anom_iforest_new(spark, d):
    """Fit on all rows, score the latest 90 days with the stored forest and
    threshold."""
    v = store(view(spark, d, *KEYS, "date", "revenue", "quantity"))
    model = anomaly.fit_isolation_forest(v, stored=True)
    latest = v.agg(F.max("date")).scalar()
    return model.transform(v.where(F.col("date") > latest - F.make_dt_interval(F.lit(90))))


@query("train_all")
def q_train_all(spark, d):
    """Tuned random-forest forecaster, product segmenter and outlier detector
    trained and saved together; one row per saved artefact."""
    sales = view(spark, d, "date", "product", "revenue", "quantity", "price")
    rows = training.train_all(sales, scratch_path(spark, f"models-{uuid.uuid4().hex[:12]}"))
    return spark.createDataFrame([(r["artefact"], r["path"], r["value"]) for r in rows], "artefact string, path string, value double")


@query("model_save")
def q_model_save(spark, d):
    """Fit and persist a forecaster; one row per saved model part."""
    fc, _ = _fit(spark, d, "linear")
    path = scratch_path(spark, f"forecaster-{uuid.uuid4().hex[:12]}")
    fc.save(path)
    meta = spark.read.text(f"{path}/meta").first()["value"]
    import json
    parts = json.loads(meta)["parts"]
    return spark.createDataFrame([(f"part{i}", kind, path) for kind, i in parts] + [("meta", "json", path)],
                                 "part string, kind string, path string")


@query("model_load", _whole(_linear_sql(0), "date"))
def q_model_load(spark, d):
    """Load a persisted forecaster and predict the day table with it."""
    fc, _ = _fit(spark, d, "linear")
    path = scratch_path(spark, f"forecaster-{uuid.uuid4().hex[:12]}")
    fc.save(path)
    loaded = forecast.Forecaster.load(path)
    return _to_units(loaded.transform(_daily(spark, d)).select("date", "revenue", "prediction"))
