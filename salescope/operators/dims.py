"""Per-dimension aggregates: products, categories, regions, stores, channels,
salespeople, statuses, weekday and month patterns.

Grouping drops null keys (the pandas default).  Ties in rankings are broken
by the dimension value so results do not depend on partitioning.  Each
operator is one hash aggregate with map-side partial aggregation, so a hot
key costs one partial row per task, not a third of the table in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixed import (DIMENSION_CANDIDATES, SALESPERSON_PROXIES, WEEKDAY_NAMES)
from ..session import store
from .common import has, pct, require, resolve_column


def _grouped(df: DataFrame, dim: str) -> DataFrame:
    return df.where(F.col(dim).isNotNull()).groupBy(dim)


def _share(df: DataFrame, value: str, out: str) -> DataFrame:
    """value / total × 100 for a per-dimension aggregate.  The total is a
    scalar subquery over the same aggregate, whose exchange Spark reuses; no
    task holds the whole dimension."""
    return df.withColumn(out, pct(F.col(value), df.agg(F.sum(value)).scalar()))


def top_products(df: DataFrame, n: int = 10, by: str = "revenue") -> DataFrame:
    """Top ``n`` products by revenue, quantity or transaction count, ranked 1..n."""
    require(df, "product")
    if by == "transactions":
        metric = F.count(F.lit(1))
    else:
        require(df, by)
        metric = F.coalesce(F.sum(by), F.lit(0.0))
    agg = _grouped(df, "product").agg(metric.alias(by))
    top = agg.orderBy(F.col(by).desc(), F.col("product")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc(), F.col("product"))))


def product_sales(df: DataFrame) -> DataFrame:
    """revenue, quantity and transactions per product (full table)."""
    require(df, "product", "revenue")
    qty = F.coalesce(F.sum("quantity"), F.lit(0.0)) if has(df, "quantity") else F.count("revenue")
    return _grouped(df, "product").agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
                                       qty.alias("qty"), F.count("revenue").alias("txn"))


def bottom_products(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` lowest-revenue products, ascending."""
    return product_sales(df).orderBy(F.col("revenue").asc(), F.col("product").desc()).limit(n)


def category_analysis(df: DataFrame) -> DataFrame:
    """Per category: total/avg/count revenue, total/avg quantity, share %."""
    require(df, "category", "revenue")
    aggs = [F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue"),
            F.avg("revenue").alias("avg_revenue"),
            F.count("revenue").alias("transactions")]
    if has(df, "quantity"):
        aggs += [F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_quantity"),
                 F.avg("quantity").alias("avg_quantity")]
    out = _grouped(df, "category").agg(*aggs)
    if not has(df, "quantity"):
        out = out.withColumns({"total_quantity": F.lit(0.0), "avg_quantity": F.lit(0.0)})
    return _share(out, "total_revenue", "revenue_pct")


def weekly_pattern(df: DataFrame) -> DataFrame:
    """Per weekday present in the data (Monday first): sum and mean of
    revenue and quantity, with the weekday index as sort key."""
    require(df, "date", "revenue")
    aggs = [F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue_sum"), F.avg("revenue").alias("revenue_mean")]
    if has(df, "quantity"):
        aggs += [F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity_sum"),
                 F.avg("quantity").alias("quantity_mean")]
    out = df.where(F.col("date").isNotNull()).groupBy(F.weekday("date").alias("day_index")).agg(*aggs)
    names = F.array(*[F.lit(x) for x in WEEKDAY_NAMES])
    return out.withColumn("day_of_week", F.element_at(names, F.col("day_index") + 1))


def weekday_means(df: DataFrame) -> DataFrame:
    """Mean revenue for all seven weekdays (null where a weekday is absent)."""
    spark = df.sparkSession
    days = spark.range(7).select(F.col("id").cast("int").alias("day_index"))
    means = df.where(F.col("date").isNotNull()).groupBy(F.weekday("date").alias("day_index")) \
              .agg(F.avg("revenue").alias("avg_revenue"))
    names = F.array(*[F.lit(x) for x in WEEKDAY_NAMES])
    # the seven-row calendar side is a fixed-size table
    return (F.broadcast(days).join(means, "day_index", "left")
            .withColumn("day_of_week", F.element_at(names, F.col("day_index") + 1)))


def month_of_year_pattern(df: DataFrame) -> DataFrame:
    """Mean revenue per calendar month (1..12) present in the data."""
    require(df, "date", "revenue")
    return (df.where(F.col("date").isNotNull()).groupBy(F.month("date").alias("month"))
              .agg(F.avg("revenue").alias("avg_revenue")))


def status_breakdown(df: DataFrame) -> DataFrame:
    """Per status: transactions, total and average revenue, % of transactions."""
    require(df, "status")
    if has(df, "revenue"):
        out = _grouped(df, "status").agg(F.count("revenue").alias("transactions"),
                                         F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue"))
        out = out.withColumn("avg_revenue", F.try_divide("total_revenue", "transactions"))
    else:
        out = _grouped(df, "status").agg(F.count(F.lit(1)).alias("transactions")) \
                .withColumn("total_revenue", F.lit(0.0))
    return _share(out, "transactions", "pct_transactions")


def top_dimension(df: DataFrame, dim: str, n: int = 15) -> DataFrame:
    """Revenue top-``n`` of any dimension."""
    require(df, dim, "revenue")
    agg = _grouped(df, dim).agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))
    return agg.orderBy(F.col("revenue").desc(), F.col(dim)).limit(n)


def dimension_performance(df: DataFrame, dim: str) -> DataFrame:
    """revenue, transactions (count of revenue) and average per transaction."""
    require(df, dim, "revenue")
    out = _grouped(df, dim).agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
                                F.count("revenue").alias("transactions"))
    return out.withColumn("avg_revenue", F.try_divide("revenue", "transactions"))


def salesperson_performance(df: DataFrame) -> DataFrame:
    col = resolve_column(df, "salesperson")
    if col is None:
        raise ValueError("no salesperson column")
    return dimension_performance(df, col)


def proxy_performance(df: DataFrame) -> DataFrame:
    """Revenue per channel | store | courier when there is no salesperson."""
    col = next((c for c in SALESPERSON_PROXIES if c in df.columns), None)
    if col is None:
        raise ValueError("no salesperson proxy column")
    return (_grouped(df, col).agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))
              .withColumn("proxy_column", F.lit(col)).withColumnRenamed(col, "proxy_value"))


def regional_analysis(df: DataFrame) -> DataFrame:
    """Per region: revenue, transactions, quantity, share %, rank."""
    col = resolve_column(df, "region")
    if col is None:
        raise ValueError("no region column")
    qty = F.coalesce(F.sum("quantity"), F.lit(0.0)) if has(df, "quantity") else F.count("revenue")
    out = _grouped(df, col).agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
                                F.count("revenue").alias("transactions"), qty.alias("quantity"))
    return rank_by(_share(out, "revenue", "revenue_share_pct"), "revenue", col)


def rank_by(df: DataFrame, value: str, name: str) -> DataFrame:
    """``rank`` 1, 2, ... by falling value of a small dimension."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).desc(), F.col(name))))


def map_values(df: DataFrame, col: str, mapping: DataFrame | dict, out: str, default=None) -> DataFrame:
    """``out`` = the value that ``mapping`` gives for ``col``, ``default`` (null)
    where it has none.  A dict becomes an expression; a table of two columns
    (value, mapped; values unique) is joined, by the strategy that Spark picks
    for its size."""
    if isinstance(mapping, dict):
        pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
        mapped = F.try_element_at(F.create_map(*pairs), F.col(col)) if pairs else F.lit(None)
        return df.withColumn(out, F.coalesce(mapped, F.lit(default)) if default is not None else mapped)
    key, value = mapping.columns
    side = mapping.where(F.col(key).isNotNull()).select(F.col(key).alias(col), F.col(value).alias(out))
    joined = df.drop(out).join(side, col, "left")
    return joined.fillna({out: default}) if default is not None else joined


def region_overview(df: DataFrame) -> DataFrame:
    """Number of regions, best and worst region by revenue (one row)."""
    reg = regional_analysis(df)
    col = resolve_column(df, "region")
    return reg.agg(F.count(F.lit(1)).alias("total_regions"),
                   F.min_by(col, "rank").alias("best_region"),
                   F.max_by(col, "rank").alias("worst_region"))


def store_analysis(df: DataFrame) -> DataFrame:
    col = resolve_column(df, "store")
    if col is None:
        raise ValueError("no store column")
    return dimension_performance(df, col).drop("avg_revenue")


def channel_analysis(df: DataFrame) -> DataFrame:
    col = resolve_column(df, "channel")
    if col is None:
        raise ValueError("no channel column")
    return dimension_performance(df, col).drop("avg_revenue")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted non-null distinct values (filter lists)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def product_features(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Put the product's transaction count and mean revenue on each row.

    Aggregate once per product and join back: the aggregate (of ``base``, or of
    ``df`` itself) has one row per product and is written, so the join is a
    shuffle on product, or a broadcast when the written table is under the
    broadcast threshold.  A window partitioned by product would put a hot
    product in one task.
    """
    require(df, "product")
    base = df if base is None else base
    aggs = [F.count(F.lit(1)).alias("product_freq")]
    if has(df, "revenue"):
        aggs.append(F.avg("revenue").alias("product_avg_revenue"))
    stats = store(base.where(F.col("product").isNotNull()).groupBy("product").agg(*aggs))
    return df.join(stats, "product", "left")


def cost_column(df: DataFrame) -> str | None:
    return next((c for c in DIMENSION_CANDIDATES["cost"] if c in df.columns), None)
