"""Scalar-function queries: calendar features, price tiers, number formats,
label encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import dims, features
from .registry import query, rnd, view, with_sales

KEYS = ["order_id", "line_no", "part_id", "supplier_id"]
KEYS_SQL = "order_id, line_no, part_id, supplier_id"


@query("time_features", with_sales(f"""
SELECT {KEYS_SQL}, date, year(date) AS year, month(date) AS month, quarter(date) AS quarter,
       isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, weekofyear(date) AS week_of_year,
       CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       strftime(date, '%B') AS month_name, strftime(date, '%Y-%m') AS year_month
FROM sales
"""))
def q_time_features(spark, d):
    return features.time_features(view(spark, d, *KEYS, "date"))


@query("revenue_per_unit", with_sales(f"""
SELECT {KEYS_SQL}, CASE WHEN quantity = 0 THEN NULL ELSE revenue / quantity END AS revenue_per_unit
FROM sales
"""))
def q_revenue_per_unit(spark, d):
    out = features.revenue_per_unit(view(spark, d, *KEYS, "revenue", "quantity"))
    return out.select(*KEYS, "revenue_per_unit")


@query("price_tier", with_sales(f"""
, q AS (SELECT quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75 FROM sales)
SELECT {KEYS_SQL}, round(price, 6) AS price,
       CASE WHEN NOT (0 < q25 AND q25 < q75) THEN NULL
            WHEN price <= 0 THEN NULL WHEN price <= q25 THEN 'Low' WHEN price <= q75 THEN 'Medium'
            WHEN price IS NOT NULL THEN 'High' END AS price_tier
FROM sales, q
"""))
def q_price_tier(spark, d):
    out = features.price_tier(view(spark, d, *KEYS, "price"))
    return rnd(out, [], ["price"])


def _fmt_sql(x: str) -> str:
    def fixed(v, digits):
        return f"printf('%.{digits}f', {v})"
    short = (f"CASE WHEN abs({x}) >= 1e12 THEN {fixed(f'{x} / 1e12', 1)} || 'T' "
             f"WHEN abs({x}) >= 1e9 THEN {fixed(f'{x} / 1e9', 1)} || 'B' "
             f"WHEN abs({x}) >= 1e6 THEN {fixed(f'{x} / 1e6', 1)} || 'M' "
             f"WHEN abs({x}) >= 1e3 THEN {fixed(f'{x} / 1e3', 1)} || 'K' "
             f"ELSE printf('%.0f', {x}) END")
    deck = ("'Rp ' || " + f"CASE WHEN {x} >= 1e12 THEN {fixed(f'{x} / 1e12', 1)} || 'T' "
            f"WHEN {x} >= 1e9 THEN {fixed(f'{x} / 1e9', 2)} || 'M' "
            f"WHEN {x} >= 1e6 THEN {fixed(f'{x} / 1e6', 1)} || 'Jt' "
            f"WHEN {x} >= 1e3 THEN {fixed(f'{x} / 1e3', 0)} || 'K' "
            f"ELSE CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) END")
    return f"'Rp ' || {short} AS revenue_label, {short} AS revenue_short, {deck} AS deck_label"


@query("format_currency", with_sales(f"""
, p AS (SELECT product, sum(revenue) AS revenue FROM sales WHERE product IS NOT NULL GROUP BY product
        UNION ALL SELECT 'ALL', sum(revenue) FROM sales
        UNION ALL SELECT 'AVG', avg(revenue) FROM sales
        UNION ALL SELECT 'MEAN_QTY', avg(quantity) FROM sales)
SELECT product, round(revenue, 4) AS revenue, {_fmt_sql('revenue')} FROM p
"""))
def q_format_currency(spark, d):
    v = view(spark, d, "product", "revenue", "quantity")
    p = dims.product_sales(v).select("product", "revenue")
    extra = v.agg(F.lit("ALL").alias("product"), F.sum("revenue").alias("revenue")) \
             .unionByName(v.agg(F.lit("AVG").alias("product"), F.avg("revenue").alias("revenue"))) \
             .unionByName(v.agg(F.lit("MEAN_QTY").alias("product"), F.avg("quantity").alias("revenue")))
    p = p.unionByName(extra)
    out = p.withColumns({"revenue_label": scalar.format_currency(F.col("revenue")),
                         "revenue_short": scalar.format_number(F.col("revenue")),
                         "deck_label": scalar.format_deck(F.col("revenue"))})
    return rnd(out, ["revenue"])


@query("label_encode", with_sales(f"""
SELECT {KEYS_SQL}, category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS DOUBLE) AS category_encoded
FROM sales
"""))
def q_label_encode(spark, d):
    return scalar.label_encode(view(spark, d, *KEYS, "category"), "category")


@query("finite_or_zero", with_sales(f"""
SELECT {KEYS_SQL}, round(coalesce(CASE WHEN quantity = 0 THEN NULL ELSE (revenue - cost * quantity) / revenue END, 0), 6)
       AS unit_margin FROM sales
"""))
def q_finite_or_zero(spark, d):
    v = view(spark, d, *KEYS, "revenue", "cost", "quantity")
    ratio = F.when(F.col("quantity") != 0, (F.col("revenue") - F.col("cost") * F.col("quantity")) / F.col("revenue"))
    return rnd(v.select(*KEYS, scalar.finite_or_zero(ratio).alias("unit_margin")), [], ["unit_margin"])
