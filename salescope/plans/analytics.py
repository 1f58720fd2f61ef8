"""Aggregation, window and join queries (KPIs, dimensions, growth, Pareto,
RFM, profit) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import customers, dims, growth, kpi, profit
from .registry import query, rnd, view, with_sales

# ---------------------------------------------------------------------------
# KPIs
# ---------------------------------------------------------------------------


@query("kpis", with_sales("""
SELECT round(sum(revenue), 4) AS total_revenue,
       round(avg(revenue), 6) AS avg_revenue,
       round(quantile_cont(revenue, 0.5), 6) AS median_revenue,
       round(sum(quantity), 4) AS total_quantity,
       round(avg(quantity), 6) AS avg_quantity,
       count(*) AS total_transactions,
       round(sum(revenue) / count(*), 6) AS avg_order_value,
       count(DISTINCT product) AS unique_products,
       count(DISTINCT customer) AS unique_customers,
       datesub('day', min(date), max(date)) AS date_range_days,
       round(sum(revenue) / greatest(datesub('day', min(date), max(date)), 1), 6) AS avg_daily_revenue
FROM sales
"""))
def q_kpis(spark, d):
    # the median reads lineitem alone: orders is a foreign-key join and the
    # part / customer lookups are on unique keys, so the revenue multiset is
    # the same as the view's
    out = kpi.kpis(view(spark, d, "date", "product", "customer", "revenue", "quantity"),
                   revenue_source=view(spark, d, "revenue"))
    return rnd(out, ["total_revenue", "total_quantity"],
               ["avg_revenue", "median_revenue", "avg_quantity", "avg_order_value", "avg_daily_revenue"])


_SUCCESS_SQL = ("regexp_matches(trim(regexp_replace(regexp_replace(lower(trim(status)), '[^a-z0-9\\s]', ' ', 'g'), "
                "'\\s+', ' ', 'g')), 'selesai|completed|complete|sukses|success|berhasil|lunas|paid|delivered|"
                "terkirim|diterima|confirmed|terkonfirmasi|approved|disetujui|finish|done|pesanan selesai|"
                "order selesai|transaksi selesai|order completed')")

_FLAGGED_SQL = f"""
, hit AS (SELECT *, coalesce({_SUCCESS_SQL}, false) AS _hit FROM sales)
, flagged AS (SELECT *, CASE WHEN (SELECT bool_or(_hit) FROM hit) THEN _hit ELSE true END
                        AS is_successful_transaction FROM hit)
"""


@query("kpi_board", with_sales(_FLAGGED_SQL + """
, m AS (SELECT date_trunc('month', date) AS month, sum(revenue) AS revenue, sum(quantity) AS quantity,
               count(*) AS n, count_if(is_successful_transaction) AS ok, sum(cost) AS cost
        FROM flagged GROUP BY 1)
, r AS (SELECT *, CASE WHEN month IS NOT NULL THEN row_number() OVER (ORDER BY month DESC) END AS rn FROM m)
, b AS (SELECT sum(revenue) AS rev, sum(quantity) AS qty, sum(n) AS n, sum(ok) AS ok, sum(cost) AS cost,
               count(rn) AS months, sum(CASE WHEN rn = 1 THEN revenue END) AS m1,
               sum(CASE WHEN rn = 2 THEN revenue END) AS m2, sum(CASE WHEN rn = 13 THEN revenue END) AS m13
        FROM r)
SELECT round(rev, 4) AS total_revenue, round(qty, 4) AS total_quantity, n AS total_transactions,
       ok AS successful_transactions,
       round(coalesce(CASE WHEN ok = 0 THEN NULL ELSE rev / ok END, 0), 6) AS avg_order_value,
       round(rev - cost, 4) AS gross_profit,
       round(coalesce(CASE WHEN rev = 0 THEN NULL ELSE (rev - cost) / rev * 100 END, 0), 6) AS margin_pct,
       round(CASE WHEN months >= 2 THEN coalesce(CASE WHEN m2 = 0 THEN NULL ELSE (m1 - m2) / m2 * 100 END, 0) END, 6) AS mom_pct,
       round(CASE WHEN months >= 13 THEN coalesce(CASE WHEN m13 = 0 THEN NULL ELSE (m1 - m13) / m13 * 100 END, 0) END, 6) AS yoy_pct
FROM b
"""))
def q_kpi_board(spark, d):
    # the success flag is derived inside the board's single aggregate pass
    out = kpi.kpi_board(view(spark, d, "date", "revenue", "quantity", "cost", "status"))
    return rnd(out, ["total_revenue", "total_quantity", "gross_profit"],
               ["avg_order_value", "margin_pct", "mom_pct", "yoy_pct"])


@query("weekend_uplift", with_sales("""
SELECT round(avg(CASE WHEN isodow(date) >= 6 THEN revenue END), 6) AS weekend_avg,
       round(avg(CASE WHEN isodow(date) < 6 THEN revenue END), 6) AS weekday_avg,
       round((avg(CASE WHEN isodow(date) >= 6 THEN revenue END) / avg(CASE WHEN isodow(date) < 6 THEN revenue END) - 1) * 100, 6) AS uplift_pct
FROM sales
"""))
def q_weekend_uplift(spark, d):
    return rnd(kpi.weekend_uplift(view(spark, d, "date", "revenue")), [], ["weekend_avg", "weekday_avg", "uplift_pct"])


# ---------------------------------------------------------------------------
# dimensions
# ---------------------------------------------------------------------------

@query("top_products", with_sales("""
SELECT product, round(revenue, 4) AS revenue, rank FROM (
  SELECT product, sum(revenue) AS revenue,
         row_number() OVER (ORDER BY sum(revenue) DESC, product) AS rank
  FROM sales WHERE product IS NOT NULL GROUP BY product) t
WHERE rank <= 10
"""))
def q_top_products(spark, d):
    return rnd(dims.top_products(view(spark, d, "product", "revenue"), 10, "revenue"), ["revenue"])


@query("top_products_quantity", with_sales("""
SELECT product, round(quantity, 4) AS quantity, rank FROM (
  SELECT product, sum(quantity) AS quantity,
         row_number() OVER (ORDER BY sum(quantity) DESC, product) AS rank
  FROM sales WHERE product IS NOT NULL GROUP BY product) t
WHERE rank <= 10
"""))
def q_top_products_quantity(spark, d):
    return rnd(dims.top_products(view(spark, d, "product", "quantity"), 10, "quantity"), ["quantity"])


@query("top_products_transactions", with_sales("""
SELECT product, transactions, rank FROM (
  SELECT product, count(*) AS transactions,
         row_number() OVER (ORDER BY count(*) DESC, product) AS rank
  FROM sales WHERE product IS NOT NULL GROUP BY product) t
WHERE rank <= 10
"""))
def q_top_products_tx(spark, d):
    return dims.top_products(view(spark, d, "product"), 10, "transactions")


@query("product_sales", with_sales("""
SELECT product, round(sum(revenue), 4) AS revenue, round(sum(quantity), 4) AS qty, count(revenue) AS txn
FROM sales WHERE product IS NOT NULL GROUP BY product
"""))
def q_product_sales(spark, d):
    return rnd(dims.product_sales(view(spark, d, "product", "revenue", "quantity")), ["revenue", "qty"])


@query("bottom_products", with_sales("""
SELECT product, round(sum(revenue), 4) AS revenue, round(sum(quantity), 4) AS qty, count(revenue) AS txn
FROM sales WHERE product IS NOT NULL GROUP BY product
ORDER BY sum(revenue) ASC, product DESC LIMIT 10
"""))
def q_bottom_products(spark, d):
    return rnd(dims.bottom_products(view(spark, d, "product", "revenue", "quantity"), 10), ["revenue", "qty"])


@query("category_analysis", with_sales("""
SELECT category, round(sum(revenue), 4) AS total_revenue, round(avg(revenue), 6) AS avg_revenue,
       count(revenue) AS transactions, round(sum(quantity), 4) AS total_quantity,
       round(avg(quantity), 6) AS avg_quantity,
       round(sum(revenue) / (SELECT sum(revenue) FROM sales WHERE category IS NOT NULL) * 100, 6) AS revenue_pct
FROM sales WHERE category IS NOT NULL GROUP BY category
"""))
def q_category(spark, d):
    out = dims.category_analysis(view(spark, d, "category", "revenue", "quantity"))
    return rnd(out, ["total_revenue", "total_quantity"], ["avg_revenue", "avg_quantity", "revenue_pct"])


_WEEKDAYS_SQL = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"


@query("weekly_pattern", with_sales(f"""
SELECT isodow(date) - 1 AS day_index, {_WEEKDAYS_SQL}[isodow(date)] AS day_of_week,
       round(sum(revenue), 4) AS revenue_sum, round(avg(revenue), 6) AS revenue_mean,
       round(sum(quantity), 4) AS quantity_sum, round(avg(quantity), 6) AS quantity_mean
FROM sales WHERE date IS NOT NULL GROUP BY isodow(date)
"""))
def q_weekly(spark, d):
    out = dims.weekly_pattern(view(spark, d, "date", "revenue", "quantity"))
    return rnd(out, ["revenue_sum", "quantity_sum"], ["revenue_mean", "quantity_mean"])


@query("weekday_means", with_sales(f"""
, m AS (SELECT isodow(date) - 1 AS day_index, avg(revenue) AS avg_revenue FROM sales
        WHERE date IS NOT NULL GROUP BY 1)
SELECT g.day_index, {_WEEKDAYS_SQL}[g.day_index + 1] AS day_of_week, round(m.avg_revenue, 6) AS avg_revenue
FROM (SELECT CAST(range AS INTEGER) AS day_index FROM range(7)) g LEFT JOIN m ON g.day_index = m.day_index
"""))
def q_weekday_means(spark, d):
    return rnd(dims.weekday_means(view(spark, d, "date", "revenue")), [], ["avg_revenue"])


@query("month_of_year_pattern", with_sales("""
SELECT month(date) AS month, round(avg(revenue), 6) AS avg_revenue
FROM sales WHERE date IS NOT NULL GROUP BY 1
"""))
def q_month_of_year(spark, d):
    return rnd(dims.month_of_year_pattern(view(spark, d, "date", "revenue")), [], ["avg_revenue"])


@query("status_breakdown", with_sales("""
SELECT status, count(revenue) AS transactions, round(sum(revenue), 4) AS total_revenue,
       round(sum(revenue) / count(revenue), 6) AS avg_revenue,
       round(count(revenue) * 100.0 / (SELECT count(revenue) FROM sales WHERE status IS NOT NULL), 6) AS pct_transactions
FROM sales WHERE status IS NOT NULL GROUP BY status
"""))
def q_status(spark, d):
    out = dims.status_breakdown(view(spark, d, "status", "revenue"))
    return rnd(out, ["total_revenue"], ["avg_revenue", "pct_transactions"])


@query("top_dimension", with_sales("""
SELECT store, round(sum(revenue), 4) AS revenue FROM sales WHERE store IS NOT NULL
GROUP BY store ORDER BY sum(revenue) DESC, store LIMIT 15
"""))
def q_top_dimension(spark, d):
    return rnd(dims.top_dimension(view(spark, d, "store", "revenue"), "store", 15), ["revenue"])


def _perf_sql(dim: str, avg: bool = True) -> str:
    extra = ", round(sum(revenue) / count(revenue), 6) AS avg_revenue" if avg else ""
    return with_sales(f"""
SELECT {dim}, round(sum(revenue), 4) AS revenue, count(revenue) AS transactions{extra}
FROM sales WHERE {dim} IS NOT NULL GROUP BY {dim}
""")


@query("salesperson_performance", _perf_sql("salesperson"))
def q_salesperson(spark, d):
    return rnd(dims.salesperson_performance(view(spark, d, "salesperson", "revenue")), ["revenue"], ["avg_revenue"])


@query("store_analysis", _perf_sql("store", avg=False))
def q_store(spark, d):
    return rnd(dims.store_analysis(view(spark, d, "store", "revenue")), ["revenue"])


@query("channel_analysis", _perf_sql("channel", avg=False))
def q_channel(spark, d):
    return rnd(dims.channel_analysis(view(spark, d, "channel", "revenue")), ["revenue"])


@query("proxy_performance", with_sales("""
SELECT channel AS proxy_value, round(sum(revenue), 4) AS revenue, 'channel' AS proxy_column
FROM sales WHERE channel IS NOT NULL GROUP BY channel
"""))
def q_proxy(spark, d):
    # the view without a salesperson column: channel is the first proxy
    return rnd(dims.proxy_performance(view(spark, d, "channel", "store", "revenue")), ["revenue"])


@query("regional_analysis", with_sales("""
SELECT region, round(sum(revenue), 4) AS revenue, count(revenue) AS transactions,
       round(sum(quantity), 4) AS quantity,
       round(sum(revenue) / (SELECT sum(revenue) FROM sales WHERE region IS NOT NULL) * 100, 6) AS revenue_share_pct,
       row_number() OVER (ORDER BY sum(revenue) DESC, region) AS rank
FROM sales WHERE region IS NOT NULL GROUP BY region
"""))
def q_regional(spark, d):
    out = dims.regional_analysis(view(spark, d, "region", "revenue", "quantity"))
    return rnd(out, ["revenue", "quantity"], ["revenue_share_pct"])


@query("region_overview", with_sales("""
, g AS (SELECT region, sum(revenue) AS revenue FROM sales WHERE region IS NOT NULL GROUP BY region)
SELECT count(*) AS total_regions, arg_max(region, revenue) AS best_region, arg_min(region, revenue) AS worst_region
FROM g
"""))
def q_region_overview(spark, d):
    return dims.region_overview(view(spark, d, "region", "revenue", "quantity"))


@query("distinct_values", with_sales("""
SELECT DISTINCT category FROM sales WHERE category IS NOT NULL
"""))
def q_distinct(spark, d):
    return dims.distinct_values(view(spark, d, "category"), "category")


@query("product_freq", with_sales("""
SELECT order_id, line_no, part_id, supplier_id, product,
       count(*) OVER (PARTITION BY product) AS product_freq,
       round(avg(revenue) OVER (PARTITION BY product), 6) AS product_avg_revenue
FROM sales
"""))
def q_product_freq(spark, d):
    out = dims.product_features(view(spark, d, "order_id", "line_no", "part_id", "supplier_id", "product", "revenue"))
    return rnd(out.drop("revenue"), [], ["product_avg_revenue"])


@query("segment_stats", with_sales("""
SELECT product, round(sum(revenue), 4) AS total_revenue, round(avg(revenue), 6) AS avg_revenue,
       count(revenue) AS transaction_count, round(sum(quantity), 4) AS total_quantity,
       round(avg(quantity), 6) AS avg_quantity, round(avg(price), 6) AS avg_price
FROM sales WHERE product IS NOT NULL GROUP BY product
"""))
def q_segment_stats(spark, d):
    from ..models.segment import product_stats
    out = product_stats(view(spark, d, "product", "revenue", "quantity", "price"))
    return rnd(out, ["total_revenue", "total_quantity"], ["avg_revenue", "avg_quantity", "avg_price"])


# ---------------------------------------------------------------------------
# periods and growth
# ---------------------------------------------------------------------------

@query("growth_metrics", with_sales("""
, m AS (SELECT date_trunc('month', date) AS date, sum(revenue) AS revenue, sum(quantity) AS quantity
        FROM sales WHERE date IS NOT NULL GROUP BY 1)
, w AS (SELECT *, lag(revenue, 1) OVER (ORDER BY date) AS p1, lag(quantity, 1) OVER (ORDER BY date) AS q1,
               lag(revenue, 12) OVER (ORDER BY date) AS p12,
               (SELECT datediff('day', min(date), max(date)) FROM m) > 365 AS long_span
        FROM m)
SELECT date, round(revenue, 4) AS revenue, round(quantity, 4) AS quantity,
       round(CASE WHEN p1 = 0 THEN NULL ELSE (revenue - p1) / p1 * 100 END, 6) AS revenue_mom,
       round(CASE WHEN q1 = 0 THEN NULL ELSE (quantity - q1) / q1 * 100 END, 6) AS quantity_mom,
       round(CASE WHEN long_span THEN (CASE WHEN p12 = 0 THEN NULL ELSE (revenue - p12) / p12 * 100 END) END, 6) AS revenue_yoy
FROM w
"""))
def q_growth_metrics(spark, d):
    out = growth.growth_metrics(view(spark, d, "date", "revenue", "quantity"))
    return rnd(out, ["revenue", "quantity"], ["revenue_mom", "quantity_mom", "revenue_yoy"])


def _period_sql(unit: str) -> str:
    return with_sales(f"""
SELECT date_trunc('{unit}', date) AS period, round(sum(revenue), 4) AS revenue
FROM sales WHERE date IS NOT NULL GROUP BY 1
""")


@query("daily_revenue", _period_sql("day"))
def q_daily(spark, d):
    return rnd(growth.period_revenue(view(spark, d, "date", "revenue"), "D"), ["revenue"])


@query("weekly_revenue", _period_sql("week"))
def q_weekly_rev(spark, d):
    return rnd(growth.period_revenue(view(spark, d, "date", "revenue"), "W"), ["revenue"])


@query("monthly_revenue", _period_sql("month"))
def q_monthly_rev(spark, d):
    return rnd(growth.period_revenue(view(spark, d, "date", "revenue"), "M"), ["revenue"])


@query("period_growth", with_sales("""
, p AS (SELECT date_trunc('week', date) AS period, sum(revenue) AS revenue FROM sales
        WHERE date IS NOT NULL GROUP BY 1)
SELECT period, round(revenue, 4) AS revenue,
       round(CASE WHEN lag(revenue) OVER w = 0 THEN NULL
                  ELSE (revenue - lag(revenue) OVER w) / lag(revenue) OVER w * 100 END, 6) AS growth_pct,
       round(avg(revenue) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma3
FROM p WINDOW w AS (ORDER BY period)
"""))
def q_period_growth(spark, d):
    return rnd(growth.period_growth(view(spark, d, "date", "revenue"), "W"), ["revenue"], ["growth_pct", "ma3"])


@query("trend_ma", with_sales("""
, p AS (SELECT date_trunc('day', date) AS period, sum(revenue) AS revenue FROM sales
        WHERE date IS NOT NULL GROUP BY 1)
SELECT period, round(revenue, 4) AS revenue,
       round(avg(revenue) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7
FROM p
"""))
def q_trend_ma(spark, d):
    return rnd(growth.trend_ma(view(spark, d, "date", "revenue"), "D", 7), ["revenue"], ["ma7"])


@query("declining_products", with_sales("""
, pm AS (SELECT date_trunc('month', date) AS month, product, sum(revenue) AS revenue FROM sales
         WHERE date IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2)
, l AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY month DESC) AS rn FROM pm)
, l3 AS (SELECT *, lead(revenue) OVER (PARTITION BY product ORDER BY rn) AS older FROM l WHERE rn <= 3)
, g AS (SELECT product, count(*) AS n, count_if(older IS NOT NULL AND revenue > older) AS ups,
               arg_max(revenue, rn) AS first_rev, arg_min(revenue, rn) AS latest_revenue FROM l3 GROUP BY product)
SELECT product, round(CASE WHEN first_rev = 0 THEN NULL ELSE (first_rev - latest_revenue) / first_rev * 100 END, 6) AS decline_pct,
       round(latest_revenue, 4) AS latest_revenue
FROM g WHERE n >= 3 AND ups = 0
"""))
def q_declining(spark, d):
    return rnd(growth.declining_products(view(spark, d, "date", "product", "revenue")), ["latest_revenue"], ["decline_pct"])


_PARETO_SQL = """
, p AS (SELECT product, sum(revenue) AS revenue FROM sales WHERE product IS NOT NULL GROUP BY product)
, c AS (SELECT product, revenue,
               sum(revenue) OVER (ORDER BY revenue DESC, product ROWS UNBOUNDED PRECEDING) AS cumsum,
               row_number() OVER (ORDER BY revenue DESC, product) AS rank,
               (SELECT sum(revenue) FROM p) AS total FROM p)
"""


@query("pareto", with_sales(_PARETO_SQL + """
SELECT product, round(revenue, 4) AS revenue, round(cumsum, 4) AS cumsum, rank,
       round(cumsum / total * 100, 6) AS cumpct, cumsum / total * 100 <= 80 AS in_top
FROM c
"""))
def q_pareto(spark, d):
    return rnd(growth.pareto(view(spark, d, "product", "revenue")), ["revenue", "cumsum"], ["cumpct"])


@query("pareto_summary", with_sales(_PARETO_SQL + """
SELECT count_if(cumsum / total * 100 <= 80) AS top_product_count, count(*) AS total_products,
       round(count_if(cumsum / total * 100 <= 80) * 100.0 / count(*), 6) AS pct_products
FROM c
"""))
def q_pareto_summary(spark, d):
    return rnd(growth.pareto_summary(view(spark, d, "product", "revenue")), [], ["pct_products"])


@query("slow_moving", with_sales("""
, p AS (SELECT product, sum(revenue) AS revenue FROM sales WHERE product IS NOT NULL GROUP BY product)
SELECT product, round(revenue, 4) AS revenue, round(revenue / (SELECT sum(revenue) FROM p) * 100, 6) AS share
FROM p ORDER BY revenue ASC, product DESC LIMIT 15
"""))
def q_slow_moving(spark, d):
    return rnd(growth.slow_moving(view(spark, d, "product", "revenue"), 15), ["revenue"], ["share"])


def _half_sql(dim: str, salesperson: bool = False, top: int | None = None) -> str:
    filt = ("AND lower(CAST(" + dim + " AS VARCHAR)) NOT IN ('online', '-', 'n/a', 'none', '')") if salesperson else ""
    lim = f"ORDER BY sum(CASE WHEN cur THEN revenue END) DESC, {dim} LIMIT {top}" if top else ""
    return with_sales(f"""
, b AS (SELECT min(date) + (max(date) - min(date)) / 2 AS mid FROM sales)
, x AS (SELECT *, date > (SELECT mid FROM b) AS cur FROM sales WHERE {dim} IS NOT NULL AND date IS NOT NULL)
SELECT {dim}, round(coalesce(sum(CASE WHEN cur THEN revenue END), 0), 4) AS revenue,
       count(CASE WHEN cur THEN revenue END) AS transactions,
       round(coalesce(sum(CASE WHEN NOT cur THEN revenue END), 0), 4) AS revenue_prev,
       round(coalesce(sum(CASE WHEN cur THEN revenue END), 0) * 1.10, 4) AS target
FROM x GROUP BY {dim} HAVING count_if(cur) > 0 {filt} {lim}
""")


@query("period_half_compare", _half_sql("region"))
def q_half_region(spark, d):
    out = growth.period_half_compare(view(spark, d, "date", "region", "revenue"), "region")
    return rnd(out, ["revenue", "revenue_prev", "target"])


@query("period_half_compare_channel", _half_sql("channel"))
def q_half_channel(spark, d):
    out = growth.period_half_compare(view(spark, d, "date", "channel", "revenue"), "channel")
    return rnd(out, ["revenue", "revenue_prev", "target"])


@query("period_half_compare_salesperson", _half_sql("salesperson", salesperson=True, top=15))
def q_half_sales(spark, d):
    out = growth.period_half_compare(view(spark, d, "date", "salesperson", "revenue"), "salesperson",
                                     salesperson=True, top=15)
    return rnd(out, ["revenue", "revenue_prev", "target"])


@query("growth_vs_prev", with_sales("""
, b AS (SELECT min(date) + (max(date) - min(date)) / 2 AS mid FROM sales)
, x AS (SELECT *, date > (SELECT mid FROM b) AS cur FROM sales WHERE region IS NOT NULL AND date IS NOT NULL)
, h AS (SELECT region, coalesce(sum(CASE WHEN cur THEN revenue END), 0) AS revenue,
               count(CASE WHEN cur THEN revenue END) AS transactions,
               coalesce(sum(CASE WHEN NOT cur THEN revenue END), 0) AS revenue_prev
        FROM x GROUP BY region HAVING count_if(cur) > 0)
, g AS (SELECT *, revenue * 1.10 AS target,
               coalesce(CASE WHEN revenue_prev = 0 THEN NULL ELSE (revenue - revenue_prev) / revenue_prev * 100 END, 0) AS growth_pct
        FROM h)
SELECT region, round(revenue, 4) AS revenue, transactions, round(revenue_prev, 4) AS revenue_prev,
       round(target, 4) AS target, round(growth_pct, 6) AS growth_pct,
       round(revenue / sum(revenue) OVER () * 100, 6) AS share_pct,
       row_number() OVER (ORDER BY revenue DESC, region) AS rank,
       round(revenue / target * 100, 6) AS achievement_pct,
       round(sum(revenue) OVER (), 4) AS total_revenue,
       round(sum(revenue_prev) OVER (), 4) AS total_revenue_prev,
       round(avg(CASE WHEN revenue_prev > 0 THEN growth_pct END) OVER (), 6) AS avg_growth_pct
FROM g
"""))
def q_growth_vs_prev(spark, d):
    half = growth.period_half_compare(view(spark, d, "date", "region", "revenue"), "region")
    out = growth.growth_vs_prev(half, "region")
    return rnd(out, ["revenue", "revenue_prev", "target", "total_revenue", "total_revenue_prev"],
               ["growth_pct", "share_pct", "achievement_pct", "avg_growth_pct"])


def _growth_dim_sql(dim: str, unit: str, top: int) -> str:
    return with_sales(f"""
, g AS (SELECT date_trunc('{unit}', date) AS period, {dim}, sum(revenue) AS revenue FROM sales
        WHERE date IS NOT NULL AND {dim} IS NOT NULL GROUP BY 1, 2)
, t AS (SELECT {dim} FROM g GROUP BY {dim} ORDER BY sum(revenue) DESC, {dim} LIMIT {top})
, p AS (SELECT period, row_number() OVER (ORDER BY period DESC) AS rk FROM (SELECT DISTINCT period FROM g))
, c AS (SELECT g.{dim}, sum(CASE WHEN rk = 1 THEN revenue END) AS curr, sum(CASE WHEN rk = 2 THEN revenue END) AS prev
        FROM g JOIN p ON g.period = p.period WHERE rk <= 2 GROUP BY g.{dim})
, o AS (SELECT t.{dim}, coalesce(c.curr, 0) AS curr, coalesce(c.prev, 0) AS prev FROM t LEFT JOIN c ON t.{dim} = c.{dim}
        WHERE (SELECT count(*) FROM p) >= 2)
SELECT {dim}, round(curr, 4) AS curr, round(prev, 4) AS prev,
       round(CASE WHEN prev > 0 THEN (curr - prev) / prev * 100 WHEN curr > 0 THEN 100.0 ELSE 0.0 END, 6) AS growth_pct
FROM o
""")


@query("growth_dim", _growth_dim_sql("product", "month", 10))
def q_growth_dim(spark, d):
    out = growth.growth_dim(view(spark, d, "date", "product", "revenue"), "product", "M", 10)
    return rnd(out, ["curr", "prev"], ["growth_pct"])


@query("growth_dim_weekly_salesperson", _growth_dim_sql("salesperson", "week", 10))
def q_growth_dim_w(spark, d):
    out = growth.growth_dim(view(spark, d, "date", "salesperson", "revenue"), "salesperson", "W", 10)
    return rnd(out, ["curr", "prev"], ["growth_pct"])


@query("dim_period_heatmap", with_sales("""
, g AS (SELECT product, date_trunc('month', date) AS period, sum(revenue) AS revenue FROM sales
        WHERE date IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2)
, t AS (SELECT product FROM g GROUP BY product ORDER BY sum(revenue) DESC, product LIMIT 10)
, ps AS (SELECT DISTINCT period FROM g)
SELECT t.product, ps.period, round(coalesce(g.revenue, 0), 4) AS revenue
FROM t CROSS JOIN ps LEFT JOIN g ON g.product = t.product AND g.period = ps.period
"""))
def q_heatmap(spark, d):
    return rnd(growth.dim_period_heatmap(view(spark, d, "date", "product", "revenue"), "product", "M", 10), ["revenue"])


@query("region_monthly", with_sales("""
, g AS (SELECT date_trunc('month', date) AS month, region, sum(revenue) AS revenue FROM sales
        WHERE date IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2)
, t AS (SELECT region FROM g GROUP BY region ORDER BY sum(revenue) DESC, region LIMIT 6)
SELECT month, region, round(revenue, 4) AS revenue FROM g WHERE region IN (SELECT region FROM t)
"""))
def q_region_monthly(spark, d):
    return rnd(growth.region_monthly(view(spark, d, "date", "region", "revenue")), ["revenue"])


# ---------------------------------------------------------------------------
# customers (RFM)
# ---------------------------------------------------------------------------

_RFM_BASE_SQL = """
, base AS (SELECT customer, datesub('day', max(date), (SELECT max(date) FROM sales)) AS recency,
                  count(revenue) AS frequency, coalesce(sum(revenue), 0) AS monetary
           FROM sales WHERE customer IS NOT NULL GROUP BY customer)
"""


@query("rfm_base", with_sales(_RFM_BASE_SQL + """
SELECT customer, recency, frequency, round(monetary, 4) AS monetary, round(monetary / frequency, 6) AS avg_order
FROM base
"""))
def q_rfm_base(spark, d):
    return rnd(customers.rfm_base(view(spark, d, "date", "customer", "revenue")), ["monetary"], ["avg_order"])


def _qcut_sql(col: str, desc: bool) -> str:
    labels = [5, 4, 3, 2, 1] if desc else [1, 2, 3, 4, 5]
    e = [f"e_{col}[{i + 1}]" for i in range(6)]
    return (f"CASE WHEN len(list_distinct(e_{col})) < 6 THEN 3 "
            f"WHEN {col} >= {e[0]} AND {col} <= {e[1]} THEN {labels[0]} "
            + " ".join(f"WHEN {col} > {e[i]} AND {col} <= {e[i + 1]} THEN {labels[i]}" for i in range(1, 5))
            + " END")


_RFM_SQL = _RFM_BASE_SQL + """
, edges AS (SELECT quantile_cont(recency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e_recency,
                   quantile_cont(frequency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e_frequency,
                   quantile_cont(monetary, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e_monetary FROM base)
, sc AS (SELECT base.*, """ + _qcut_sql("recency", True) + """ AS recency_score,
                """ + _qcut_sql("frequency", False) + """ AS frequency_score,
                """ + _qcut_sql("monetary", False) + """ AS monetary_score
         FROM base, edges)
, rfm AS (SELECT *, recency_score + frequency_score + monetary_score AS rfm_score FROM sc)
, seg AS (SELECT *, CASE WHEN rfm_score >= 13 THEN 'Champions' WHEN rfm_score >= 10 THEN 'Loyal'
                         WHEN rfm_score >= 7 THEN 'Potential' WHEN rfm_score >= 4 THEN 'At Risk'
                         ELSE 'Lost' END AS segment FROM rfm)
"""


@query("rfm_scores", with_sales(_RFM_SQL + """
SELECT customer, recency, frequency, round(monetary, 4) AS monetary, round(monetary / frequency, 6) AS avg_order,
       recency_score, frequency_score, monetary_score, rfm_score, segment
FROM seg
"""))
def q_rfm(spark, d):
    out = customers.rfm(view(spark, d, "date", "customer", "revenue"))
    return rnd(out, ["monetary"], ["avg_order"])


@query("rfm_segments", with_sales(_RFM_SQL + """
SELECT segment, count(*) AS customers, round(sum(monetary), 4) AS monetary FROM seg GROUP BY segment
"""))
def q_rfm_segments(spark, d):
    return rnd(customers.rfm_segments(customers.rfm(view(spark, d, "date", "customer", "revenue"))), ["monetary"])


@query("top_customers", with_sales(_RFM_BASE_SQL + """
SELECT customer, recency, frequency, round(monetary, 4) AS monetary, round(monetary / frequency, 6) AS avg_order
FROM base ORDER BY monetary DESC, customer LIMIT 15
"""))
def q_top_customers(spark, d):
    base = customers.rfm_base(view(spark, d, "date", "customer", "revenue"))
    return rnd(customers.top_customers(base, "monetary", 15), ["monetary"], ["avg_order"])


@query("recency_histogram", with_sales(_RFM_BASE_SQL + """
, mm AS (SELECT min(recency) AS lo, max(recency) AS hi, (max(recency) - min(recency)) / 20.0 AS w FROM base)
, c AS (SELECT CAST(least(CASE WHEN w > 0 THEN floor((recency - lo) / w) ELSE 0 END, 19) AS INTEGER) AS bin,
               count(*) AS customers FROM base, mm GROUP BY 1)
SELECT g.bin, coalesce(c.customers, 0) AS customers, round(lo + g.bin * w, 6) AS lower, round(lo + (g.bin + 1) * w, 6) AS upper
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) g LEFT JOIN c ON g.bin = c.bin, mm
"""))
def q_recency_hist(spark, d):
    base = customers.rfm_base(view(spark, d, "date", "customer", "revenue"))
    return rnd(customers.recency_histogram(base, 20), [], ["lower", "upper"])


# ---------------------------------------------------------------------------
# profitability
# ---------------------------------------------------------------------------

_PROFIT_SQL = """
, pp AS (SELECT product, coalesce(sum(revenue), 0) AS revenue, coalesce(sum(cost), 0) AS cost, count(revenue) AS txn
         FROM sales WHERE product IS NOT NULL GROUP BY product)
, pr AS (SELECT *, revenue - cost AS profit,
                CASE WHEN revenue = 0 THEN NULL ELSE (revenue - cost) / revenue * 100 END AS margin_pct FROM pp)
"""


@query("profitability_product", with_sales(_PROFIT_SQL + """
SELECT product, round(revenue, 4) AS revenue, round(cost, 4) AS cost, txn, round(profit, 4) AS profit,
       round(margin_pct, 6) AS margin_pct FROM pr
"""))
def q_profitability(spark, d):
    out = profit.profitability_product(view(spark, d, "product", "revenue", "cost"))
    return rnd(out, ["revenue", "cost", "profit"], ["margin_pct"])


@query("profit_deck_stats", with_sales(_PROFIT_SQL + """
SELECT round(sum(profit), 4) AS total_profit, round(sum(revenue), 4) AS total_revenue,
       round(avg(margin_pct), 6) AS avg_margin, count(*) AS products
FROM pr WHERE margin_pct IS NOT NULL
"""))
def q_profit_deck(spark, d):
    out = profit.profit_deck_stats(view(spark, d, "product", "revenue", "cost"))
    return rnd(out, ["total_profit", "total_revenue"], ["avg_margin"])


@query("margin_extremes", with_sales(_PROFIT_SQL + """
, ok AS (SELECT * FROM pr WHERE margin_pct IS NOT NULL)
, b AS (SELECT *, 'best' AS side FROM ok ORDER BY margin_pct DESC, product LIMIT 8)
, w AS (SELECT *, 'worst' AS side FROM ok ORDER BY margin_pct ASC, product LIMIT 8)
SELECT product, round(revenue, 4) AS revenue, round(cost, 4) AS cost, txn, round(profit, 4) AS profit,
       round(margin_pct, 6) AS margin_pct, side FROM (SELECT * FROM b UNION ALL SELECT * FROM w)
"""))
def q_margin_extremes(spark, d):
    out = profit.margin_extremes(view(spark, d, "product", "revenue", "cost"), 8)
    return rnd(out, ["revenue", "cost", "profit"], ["margin_pct"])


@query("profit_flat_margin", with_sales("""
SELECT product, round(sum(revenue), 4) AS revenue, count(revenue) AS txn,
       round(sum(revenue) * 0.3, 4) AS profit, 30.0 AS margin_pct
FROM sales WHERE product IS NOT NULL GROUP BY product
"""))
def q_profit_flat(spark, d):
    # the view without a cost column: the flat margin applies
    out = profit.profit_flat_margin(view(spark, d, "product", "revenue"), 30)
    return rnd(out, ["revenue", "profit"])


@query("profit_totals", with_sales("""
SELECT round(sum(revenue), 4) AS total_revenue, round(sum(revenue - cost), 4) AS total_profit,
       round(avg(CASE WHEN revenue = 0 THEN NULL ELSE (revenue - cost) / revenue * 100 END), 6) AS avg_margin
FROM sales
"""))
def q_profit_totals(spark, d):
    out = profit.profit_totals(view(spark, d, "revenue", "cost"))
    return rnd(out, ["total_revenue", "total_profit"], ["avg_margin"])


@query("row_lags", with_sales("""
SELECT order_id, line_no, part_id, supplier_id,
       round(lag(revenue, 1) OVER w, 6) AS revenue_lag_1,
       round(lag(revenue, 7) OVER w, 6) AS revenue_lag_7,
       round(CASE WHEN row_number() OVER w >= 7 THEN avg(revenue) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 6)
         AS revenue_rolling_mean_7,
       round(CASE WHEN row_number() OVER w >= 7 THEN stddev_samp(revenue) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 6)
         AS revenue_rolling_std_7
FROM sales
WINDOW w AS (ORDER BY date, order_id, line_no, part_id, supplier_id, ship_date, revenue)
"""))
def q_row_lags(spark, d):
    """Transaction-order lags and 7-row rolling mean / std over the whole
    table, computed bucket by bucket (no single-task window)."""
    from ..operators.ordered import row_lags
    from ..sources.tables import ROW_ORDER
    out = row_lags(view(spark, d, *ROW_ORDER), ROW_ORDER, "revenue", lags=(1, 7), window=7)
    cols = ["revenue_lag_1", "revenue_lag_7", "revenue_rolling_mean_7", "revenue_rolling_std_7"]
    return rnd(out.select("order_id", "line_no", "part_id", "supplier_id", *cols), [], cols)


@query("map_values", with_sales("""
, m AS (SELECT n.n_name AS region, r.r_name AS region_group FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT m.region_group, round(sum(s.revenue), 4) AS revenue, count(*) AS transactions
FROM sales s LEFT JOIN m ON s.region = m.region GROUP BY m.region_group
"""))
def q_map_values(spark, d):
    """Map each region to its region group through a value-map table (one
    row per nation: the nation table's size is fixed by the schema)."""
    from ..sources.tables import read_table
    nation = read_table(spark, d, "nation")
    region = read_table(spark, d, "region")
    mapping = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]) \
                    .select(F.col("n_name").alias("region"), F.col("r_name").alias("region_group"))
    s = dims.map_values(view(spark, d, "region", "revenue"), "region", mapping, "region_group")
    out = s.groupBy("region_group").agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("transactions"))
    return rnd(out, ["revenue"])


@query("growth_dim_extremes", with_sales("""
, g AS (SELECT date_trunc('month', date) AS period, product, sum(revenue) AS revenue FROM sales
        WHERE date IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2)
, t AS (SELECT product FROM g GROUP BY product ORDER BY sum(revenue) DESC, product LIMIT 10)
, p AS (SELECT period, row_number() OVER (ORDER BY period DESC) AS rk FROM (SELECT DISTINCT period FROM g))
, c AS (SELECT g.product, sum(CASE WHEN rk = 1 THEN revenue END) AS curr, sum(CASE WHEN rk = 2 THEN revenue END) AS prev
        FROM g JOIN p ON g.period = p.period WHERE rk <= 2 GROUP BY g.product)
, o AS (SELECT t.product, coalesce(c.curr, 0) AS curr, coalesce(c.prev, 0) AS prev FROM t LEFT JOIN c ON t.product = c.product)
, gr AS (SELECT product, curr, CASE WHEN prev > 0 THEN (curr - prev) / prev * 100 WHEN curr > 0 THEN 100.0 ELSE 0.0 END AS growth_pct FROM o)
, best AS (SELECT 'fastest' AS side, * FROM gr ORDER BY growth_pct DESC, product LIMIT 5)
, worst AS (SELECT 'declining' AS side, * FROM gr ORDER BY growth_pct ASC, product LIMIT 5)
SELECT side, product, round(curr, 4) AS curr, round(growth_pct, 6) AS growth_pct FROM (SELECT * FROM best UNION ALL SELECT * FROM worst)
"""))
def q_growth_dim_extremes(spark, d):
    """The 5 fastest-growing and 5 most-declining of the top-10 products
    (last month vs the month before)."""
    g = growth.growth_dim(view(spark, d, "date", "product", "revenue"), "product", "M", 10)
    best = g.orderBy(F.col("growth_pct").desc(), F.col("product")).limit(5).withColumn("side", F.lit("fastest"))
    worst = g.orderBy(F.col("growth_pct").asc(), F.col("product")).limit(5).withColumn("side", F.lit("declining"))
    out = best.unionByName(worst).select("side", "product", "curr", "growth_pct")
    return rnd(out, ["curr"], ["growth_pct"])


@query("top_customers_frequency", with_sales(_RFM_BASE_SQL + """
SELECT customer, recency, frequency, round(monetary, 4) AS monetary, round(monetary / frequency, 6) AS avg_order
FROM base ORDER BY frequency DESC, customer LIMIT 15
"""))
def q_top_customers_freq(spark, d):
    """The 15 most frequent (repeat) customers."""
    base = customers.rfm_base(view(spark, d, "date", "customer", "revenue"))
    return rnd(customers.top_customers(base, "frequency", 15), ["monetary"], ["avg_order"])


@query("status_counts", with_sales("""
SELECT status, count(*) AS transactions, 0.0 AS total_revenue,
       round(count(*) * 100.0 / (SELECT count(*) FROM sales WHERE status IS NOT NULL), 6) AS pct_transactions
FROM sales WHERE status IS NOT NULL GROUP BY status
"""))
def q_status_counts(spark, d):
    """The count-only status breakdown of a table without revenue."""
    return rnd(dims.status_breakdown(view(spark, d, "status")), [], ["pct_transactions"])
