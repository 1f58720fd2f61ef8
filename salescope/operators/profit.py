"""Profitability per product and in total.

Cost is summed as stored (a unit cost such as HPP is *not* multiplied by the
quantity) unless ``cost_mode='extended'``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_MARGIN_PCT
from .common import pct, require, resolve_column
from .dims import cost_column


def _row_cost(df: DataFrame, cost: str, cost_mode: str) -> F.Column:
    c = F.col(cost)
    return c * F.col("quantity") if cost_mode == "extended" else c


def profitability_product(df: DataFrame, cost_mode: str = "unit") -> DataFrame:
    """Per product: revenue, cost, profit, margin % (NULL on zero revenue), txn."""
    prod = resolve_column(df, "product")
    cost = cost_column(df)
    if prod is None or cost is None:
        raise ValueError("profitability needs product and cost columns")
    out = (df.where(F.col(prod).isNotNull()).groupBy(prod)
             .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
                  F.coalesce(F.sum(_row_cost(df, cost, cost_mode)), F.lit(0.0)).alias("cost"),
                  F.count("revenue").alias("txn")))
    out = out.withColumn("profit", F.col("revenue") - F.col("cost"))
    out = out.withColumn("margin_pct", pct(F.col("profit"), F.col("revenue")))
    return out.withColumnRenamed(prod, "product") if prod != "product" else out


def profit_flat_margin(df: DataFrame, margin_pct: float = DEFAULT_MARGIN_PCT) -> DataFrame:
    """No cost column: profit = revenue × margin for every product."""
    if not 1 <= margin_pct <= 90:
        raise ValueError("margin must be within 1..90 percent")
    prod = resolve_column(df, "product")
    require(df, "revenue")
    out = (df.where(F.col(prod).isNotNull()).groupBy(prod)
             .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"), F.count("revenue").alias("txn")))
    return out.withColumns({"profit": F.col("revenue") * F.lit(margin_pct / 100.0),
                            "margin_pct": F.lit(float(margin_pct))})


def profit_totals(df: DataFrame, margin_pct: float = DEFAULT_MARGIN_PCT, cost_mode: str = "unit") -> DataFrame:
    """Total revenue, total profit and the mean of *row* margins."""
    require(df, "revenue")
    cost = cost_column(df)
    if cost:
        profit = F.col("revenue") - _row_cost(df, cost, cost_mode)
        margin = pct(profit, F.col("revenue"))
    else:
        profit = F.col("revenue") * F.lit(margin_pct / 100.0)
        margin = F.lit(float(margin_pct))
    return df.agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue"),
                  F.coalesce(F.sum(profit), F.lit(0.0)).alias("total_profit"),
                  F.avg(margin).alias("avg_margin"))


def profit_deck_stats(df: DataFrame, cost_mode: str = "unit") -> DataFrame:
    """Total profit, total revenue and the unweighted mean of product margins
    over products with a margin."""
    p = profitability_product(df, cost_mode).where(F.col("margin_pct").isNotNull())
    return p.agg(F.sum("profit").alias("total_profit"), F.sum("revenue").alias("total_revenue"),
                 F.avg("margin_pct").alias("avg_margin"), F.count(F.lit(1)).alias("products"))


def margin_extremes(df: DataFrame, n: int = 8, cost_mode: str = "unit") -> DataFrame:
    """The ``n`` best and ``n`` worst products by margin, tagged."""
    p = profitability_product(df, cost_mode).where(F.col("margin_pct").isNotNull())
    best = p.orderBy(F.col("margin_pct").desc(), F.col("product")).limit(n).withColumn("side", F.lit("best"))
    worst = p.orderBy(F.col("margin_pct").asc(), F.col("product")).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)
