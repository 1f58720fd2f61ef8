"""The report bundle: every analysis from one pass over the transactions.

One aggregate with grouping sets counts and sums the transactions by product
and month, by each other dimension, and in total.  Its rows (a handful of
numbers per dimension value, combined inside the tasks) are written once; all
analyses are built on them, so the transactions are read once, and once more
for the rounds of the exact median.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import reread
from . import growth
from .common import days_between, has, pct, period_start, require, resolve_column
from .dims import _share, rank_by
from .kpi import kpis_of
from .ordered import exact_quantiles
from .profit import cost_column

DIMENSIONS = ["category", "region", "store", "channel", "salesperson", "customer"]
TOP_PRODUCTS = 30


def cube(df: DataFrame) -> DataFrame:
    """Counts and sums by (product, month), by each further dimension that the
    table has, and over all rows.  ``part`` names the dimension of a row."""
    require(df, "date", "revenue", "product")
    dims = {d: c for d in DIMENSIONS if (c := resolve_column(df, d))}
    number = lambda c: F.col(c) if c and c in df.columns else F.lit(None).cast("double")
    rows = df.select(
        F.col("product"), period_start(F.col("date"), "M").alias("month"), *[F.col(c).alias(d) for d, c in dims.items()],
        "date", "revenue", number("quantity").alias("quantity"), number(cost_column(df)).alias("cost"))
    part = F.when(F.grouping("product") == 0, F.lit("product"))
    for d in dims:
        part = part.when(F.grouping(d) == 0, F.lit(d))
    out = rows.groupingSets([["product", "month"], *[[d] for d in dims], []], "product", "month", *dims).agg(
        part.otherwise(F.lit("all")).alias("part"), F.count(F.lit(1)).alias("rows"),
        F.sum("revenue").alias("revenue"), F.count("revenue").alias("transactions"),
        F.sum("quantity").alias("quantity"), F.count("quantity").alias("quantities"), F.sum("cost").alias("cost"),
        F.min("date").alias("first"), F.max("date").alias("last"))
    return out.withColumn("value", F.coalesce("product", *dims)).drop("product", *dims)


def _zero(c: str) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0.0)).alias(c)


def _dimension(cells: DataFrame, name: str) -> DataFrame:
    """One row per value of a dimension (nulls left out)."""
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("revenue", "quantity")}
    return (cells.where((F.col("part") == name) & F.col("value").isNotNull())
            .withColumn("avg_revenue", F.try_divide("revenue", "transactions"))
            .withColumn("avg_quantity", F.try_divide("quantity", "quantities"))
            .withColumns(zero).withColumnRenamed("value", name))


def report_bundle(df: DataFrame, path: str, revenue_source: DataFrame | None = None) -> dict[str, DataFrame]:
    """{name: result} of the bundle's analyses; ``path`` is a folder for the
    aggregate's rows.  Dimensions that the table lacks have no result."""
    cells = reread(cube(df), path)
    products = cells.where((F.col("part") == "product") & F.col("value").isNotNull()).withColumnRenamed("value", "product")
    months = cells.where((F.col("part") == "product") & F.col("month").isNotNull()).drop("date").withColumnRenamed("month", "date")
    by_product = products.groupBy("product").agg(_zero("revenue"), _zero("cost"), F.sum("transactions").alias("txn"))
    everything = cells.where(F.col("part") == "all")
    distinct = {f"unique_{d}s": cells.where((F.col("part") == d)).agg(F.countDistinct("value")).scalar()
                for d in ("product", "customer") if d == "product" or resolve_column(df, d)}
    (median,) = exact_quantiles(revenue_source if revenue_source is not None else df, "revenue", [0.5])
    total = everything.select(
        F.coalesce("revenue", F.lit(0.0)).alias("total_revenue"), F.try_divide("revenue", "transactions").alias("avg_revenue"),
        *([F.coalesce("quantity", F.lit(0.0)).alias("total_quantity"), F.try_divide("quantity", "quantities").alias("avg_quantity")]
          if has(df, "quantity") else []),
        F.col("rows").alias("total_transactions"), *[v.alias(k) for k, v in distinct.items()],
        days_between(F.col("first"), F.col("last")).alias("date_range_days"))
    out = {"kpis": kpis_of(total, median), "monthly_growth": growth.growth_metrics(months)}

    def dimension(name: str) -> DataFrame | None:
        return _dimension(cells, name) if resolve_column(df, name) else None

    if (c := dimension("category")) is not None:
        c = c.select("category", F.col("revenue").alias("total_revenue"), "avg_revenue", "transactions",
                     F.col("quantity").alias("total_quantity"), "avg_quantity")
        out["category_analysis"] = _share(c, "total_revenue", "revenue_pct")
    declining = products.where(F.col("month").isNotNull()).drop("date").withColumnRenamed("month", "date")
    out["declining_products"] = growth.declining_products(declining)
    out["top_products"] = by_product.select("product", "revenue").orderBy(F.col("revenue").desc(), "product").limit(TOP_PRODUCTS)
    if (s := dimension("salesperson")) is not None:
        out["salesperson_performance"] = s.select("salesperson", "revenue", "transactions", "avg_revenue")
    if (r := dimension("region")) is not None:
        r = r.select("region", "revenue", "transactions", "quantity")
        out["regional_analysis"] = rank_by(_share(r, "revenue", "revenue_share_pct"), "revenue", "region")
    for name in ("store", "channel"):
        if (d := dimension(name)) is not None:
            out[f"{name}_analysis"] = d.select(name, "revenue", "transactions")
    if (u := dimension("customer")) is not None:
        now = everything.agg(F.max("last")).scalar()
        out["customer_rfm"] = u.select("customer", days_between(F.col("last"), now).alias("recency"),
                                       F.col("transactions").alias("frequency"), F.col("revenue").alias("monetary"),
                                       F.try_divide("revenue", "transactions").alias("avg_order"))
    if cost_column(df):
        profit = F.col("revenue") - F.col("cost")
        out["profitability"] = by_product.select("product", "revenue", "cost", "txn", profit.alias("profit"),
                                                 pct(profit, F.col("revenue")).alias("margin_pct"))
    return out
