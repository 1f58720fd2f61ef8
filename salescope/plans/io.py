"""Source / sink queries: every query writes files derived from the tables
into the session's shared scratch folder and reads them back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import bundle
from ..operators.common import union_all
from ..session import scratch_path
from ..sources import files
from ..sources.tables import ROW_ORDER
from . import analytics  # noqa: F401  (the analyses' SQL)
from .registry import ORACLES, query, rnd, view, with_sales


def _fresh(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@query("read_csv", with_sales("""
SELECT date, order_id, line_no, product, round(revenue, 4) AS revenue FROM sales
"""))
def q_read_csv(spark, d):
    path = _fresh(spark, "upload-csv")
    src = rnd(view(spark, d, "date", "order_id", "line_no", "product", "revenue"), ["revenue"])
    src.write.option("header", True).csv(path)
    out = files.load_data(spark, path, "csv")
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("read_json", with_sales("""
SELECT date, order_id, line_no, product, round(revenue, 4) AS revenue FROM sales
"""))
def q_read_json(spark, d):
    path = _fresh(spark, "upload-json")
    src = rnd(view(spark, d, "date", "order_id", "line_no", "product", "revenue"), ["revenue"])
    src.write.json(path)
    out = files.load_data(spark, path, "json")
    return out.select(F.col("date").cast("timestamp_ntz").alias("date"), "order_id",
                      F.col("line_no").cast("int").alias("line_no"), "product", "revenue")


@query("union_files", with_sales("""
SELECT date, order_id, line_no, round(revenue, 4) AS revenue,
       CASE WHEN status = 'Completed' THEN NULL ELSE channel END AS channel
FROM sales
"""))
def q_union_files(spark, d):
    """Finished orders come as CSV, open ones as JSON with an extra column,
    and a text export that is skipped; the union keeps every row."""
    base = rnd(view(spark, d, "date", "order_id", "line_no", "revenue", "channel", "status"), ["revenue"])
    root = _fresh(spark, "uploads")
    a, b, c = (os.path.join(root, "finished.csv"), os.path.join(root, "open.json"),
               os.path.join(root, "notes.txt"))
    base.where(F.col("status") == "Completed").select("date", "order_id", "line_no", "revenue") \
        .write.option("header", True).csv(a)
    base.where(F.col("status") != "Completed").select("date", "order_id", "line_no", "revenue", "channel") \
        .write.json(b)
    base.select(F.col("order_id").cast("string").alias("value")).write.text(c)
    detected = [files.detect_format(a), files.detect_format(b)]
    assert detected == ["csv", "json"]
    out = files.union_files(spark, [a, b, c])
    return out.select(F.col("date").cast("timestamp_ntz").alias("date"), F.col("order_id").cast("long"),
                      F.col("line_no").cast("int"), F.col("revenue").cast("double"), "channel")


@query("write_processed", with_sales("""
SELECT strftime(date, '%Y-%m') AS year_month, count(*) AS rows, round(sum(revenue), 4) AS revenue
FROM sales GROUP BY 1
"""))
def q_write_processed(spark, d):
    path = _fresh(spark, "processed")
    files.write_processed(view(spark, d, "date", "order_id", "line_no", "revenue"), path)
    back = spark.read.parquet(path)
    out = back.groupBy("year_month").agg(F.count(F.lit(1)).alias("rows"), F.sum("revenue").alias("revenue"))
    return rnd(out.withColumn("year_month", F.col("year_month").cast("string")), ["revenue"])


#: Key column and figures of every result of the bundle.
_BUNDLE = {
    "kpis": (None, ["total_revenue", "avg_revenue", "median_revenue", "total_quantity", "avg_quantity", "total_transactions",
                    "avg_order_value", "unique_products", "unique_customers", "date_range_days", "avg_daily_revenue"]),
    "monthly_growth": ("date", ["revenue", "quantity", "revenue_mom", "quantity_mom", "revenue_yoy"]),
    "category_analysis": ("category", ["total_revenue", "avg_revenue", "transactions", "total_quantity", "avg_quantity", "revenue_pct"]),
    "declining_products": ("product", ["decline_pct", "latest_revenue"]),
    "top_products": ("product", ["revenue"]),
    "salesperson_performance": ("salesperson", ["revenue", "transactions", "avg_revenue"]),
    "regional_analysis": ("region", ["revenue", "transactions", "quantity", "revenue_share_pct", "rank"]),
    "store_analysis": ("store", ["revenue", "transactions"]),
    "channel_analysis": ("channel", ["revenue", "transactions"]),
    "customer_rfm": ("customer", ["recency", "frequency", "monetary", "avg_order"]),
    "profitability": ("product", ["revenue", "cost", "txn", "profit", "margin_pct"]),
}
_BUNDLE_MONEY = ["total_revenue", "total_quantity", "revenue", "quantity", "latest_revenue", "monetary", "cost", "profit"]


def _bundle_sql() -> str:
    """The contents of every file, in long form, from the analyses' own SQL."""
    own = {"monthly_growth": "growth_metrics", "customer_rfm": "rfm_base", "profitability": "profitability_product"}
    parts, rows = [], []
    for name, (key, figures) in _BUNDLE.items():
        sql = ORACLES[own.get(name, name if name != "top_products" else "top_dimension")]
        if name == "top_products":
            head, tail = sql.rsplit("SELECT store", 1)
            sql = head + "SELECT store".replace("store", "product") + tail.replace("store", "product").replace("LIMIT 15", "LIMIT 30")
        parts.append(f"r_{name} AS MATERIALIZED ({sql})")
        shown = {None: "''", "date": "strftime(date, '%Y-%m-%d')"}.get(key, key)
        rows += [f"SELECT '{name}' AS name, {shown} AS key, '{f}' AS figure, CAST({f} AS DOUBLE) AS value FROM r_{name}" for f in figures]
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(rows)


@query("write_csv_bundle", _bundle_sql())
def q_write_bundle(spark, d):
    """Every analysis of the report bundle, from one aggregate, written as CSV
    and read back: one row per figure of every file."""
    v = view(spark, d, "date", "product", "category", "customer", "region", "store", "channel",
             "salesperson", "quantity", "price", "revenue", "cost")
    results = bundle.report_bundle(v, _fresh(spark, "cube"), revenue_source=view(spark, d, "revenue"))
    written = files.write_bundle(results, _fresh(spark, "bundle"), "csv")
    frames = []
    for name, path in written.items():
        key, figures = _BUNDLE[name]
        back = rnd(spark.read.option("header", True).csv(path).withColumns({f: F.col(f).cast("double") for f in figures}),
                   [f for f in figures if f in _BUNDLE_MONEY], [f for f in figures if f not in _BUNDLE_MONEY])
        shown = F.lit("") if key is None else F.substring(key, 1, 10) if key == "date" else F.col(key)
        frames.append(back.select(F.lit(name).alias("name"), shown.alias("key"), *figures).unpivot(["name", "key"], figures, "figure", "value"))
    return union_all(frames)


@query("preview", with_sales("""
SELECT date, order_id, line_no, part_id, supplier_id, ship_date, round(revenue, 4) AS revenue, product
FROM sales ORDER BY date, order_id, line_no, part_id, supplier_id, ship_date, revenue LIMIT 10
"""))
def q_preview(spark, d):
    v = view(spark, d, *ROW_ORDER, "product")
    return rnd(files.preview(v, ROW_ORDER, 10), ["revenue"])
