"""Period growth, trends, declining products, Pareto, half-period comparison.

Period series (days, weeks, months) are aggregates whose size is bounded by
the calendar span, so a window over them runs in one small task.  Windows
over per-product aggregates are partitioned by product (a product has at most
one row per period).  The Pareto ranking can have as many rows as there are
products and uses the distributed running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixed import NON_SALESPERSON_NAMES, TARGET_UPLIFT
from .common import has, pct, period_start, require, to_numeric, wall_micros
from .ordered import running_sum


def period_revenue(df: DataFrame, freq: str = "M") -> DataFrame:
    """Revenue per day / week / month (period start timestamp)."""
    require(df, "date", "revenue")
    return (df.where(F.col("date").isNotNull())
              .groupBy(period_start(F.col("date"), freq).alias("period"))
              .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue")))


def growth_metrics(df: DataFrame) -> DataFrame:
    """Monthly revenue and quantity with MoM % (previous *row*) and, when the
    months span more than 365 days, YoY % (12 rows back)."""
    require(df, "date", "revenue")
    aggs = [F.coalesce(F.sum(to_numeric(F.col("revenue"))), F.lit(0.0)).alias("revenue")]
    if has(df, "quantity"):
        aggs.append(F.coalesce(F.sum(to_numeric(F.col("quantity"))), F.lit(0.0)).alias("quantity"))
    monthly = (df.where(F.col("date").isNotNull())
                 .groupBy(period_start(F.col("date"), "M").alias("date")).agg(*aggs))
    w = Window.orderBy("date")  # one row per month: a bounded table
    out = monthly.withColumn("revenue_mom", pct(F.col("revenue") - F.lag("revenue", 1).over(w),
                                                 F.lag("revenue", 1).over(w)))
    if has(df, "quantity"):
        out = out.withColumn("quantity_mom", pct(F.col("quantity") - F.lag("quantity", 1).over(w),
                                                  F.lag("quantity", 1).over(w)))
    span = Window.partitionBy()
    long_enough = (F.datediff(F.max("date").over(span), F.min("date").over(span)) > 365)
    yoy = pct(F.col("revenue") - F.lag("revenue", 12).over(w), F.lag("revenue", 12).over(w))
    return out.withColumn("revenue_yoy", F.when(long_enough, yoy))


def period_growth(df: DataFrame, freq: str = "M") -> DataFrame:
    """Weekly or monthly revenue, % change vs previous period row and a
    3-period moving mean (at least one value)."""
    p = period_revenue(df, freq)
    w = Window.orderBy("period")
    prev = F.lag("revenue", 1).over(w)
    return p.withColumns({"growth_pct": pct(F.col("revenue") - prev, prev),
                          "ma3": F.avg("revenue").over(w.rowsBetween(-2, 0))})


def trend_ma(df: DataFrame, freq: str = "D", window: int = 7) -> DataFrame:
    """Revenue per period with a ``window``-period moving mean (min 1)."""
    p = period_revenue(df, freq)
    w = Window.orderBy("period").rowsBetween(-(window - 1), 0)
    return p.withColumn(f"ma{window}", F.avg("revenue").over(w))


def declining_products(df: DataFrame, periods: int = 3) -> DataFrame:
    """Products whose revenue over their last ``periods`` present months never
    increases (ties allowed); decline % from the first to the last of those
    months and the latest revenue.  Sorted by decline % descending."""
    require(df, "date", "product", "revenue")
    pm = (df.where(F.col("date").isNotNull() & F.col("product").isNotNull())
            .groupBy(period_start(F.col("date"), "M").alias("month"), "product")
            .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue")))
    w = Window.partitionBy("product").orderBy(F.col("month").desc())
    last = pm.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= periods)
    # the row "rn" must not exceed the row "rn + 1" (older month) for a decline
    wo = Window.partitionBy("product").orderBy("rn")
    last = last.withColumn("older", F.lead("revenue", 1).over(wo))
    agg = last.groupBy("product").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("older").isNotNull() & (F.col("revenue") > F.col("older"))).alias("ups"),
        F.max_by("revenue", "rn").alias("first_rev"),
        F.min_by("revenue", "rn").alias("latest_revenue"),
    )
    out = agg.where((F.col("n") >= periods) & (F.col("ups") == 0))
    return out.select("product",
                      pct(F.col("first_rev") - F.col("latest_revenue"), F.col("first_rev")).alias("decline_pct"),
                      "latest_revenue")


def pareto(df: DataFrame, share: float = 80.0) -> DataFrame:
    """Products by revenue descending with cumulative revenue, cumulative %
    and rank; ``in_top`` marks the products with cumulative % ≤ ``share``."""
    require(df, "product", "revenue")
    prod = (df.where(F.col("product").isNotNull()).groupBy("product")
              .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue")))
    ranked = running_sum(prod, [F.col("revenue").desc(), F.col("product").asc()], "revenue", "cumsum", "rank",
                         total="_total")   # the grand total comes from the bucket summaries
    out = ranked.withColumn("cumpct", pct(F.col("cumsum"), F.col("_total"))).drop("_total")
    return out.withColumn("in_top", F.col("cumpct") <= F.lit(share))


def pareto_summary(df: DataFrame, share: float = 80.0) -> DataFrame:
    """How many products make ``share`` % of revenue, of how many, and the %."""
    p = pareto(df, share)
    return (p.agg(F.count_if("in_top").alias("top_product_count"), F.count(F.lit(1)).alias("total_products"))
             .withColumn("pct_products", pct(F.col("top_product_count"), F.col("total_products"))))


def slow_moving(df: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` lowest-revenue products with their share of total revenue."""
    require(df, "product", "revenue")
    prod = (df.where(F.col("product").isNotNull()).groupBy("product")
              .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue")))
    low = prod.orderBy(F.col("revenue").asc(), F.col("product").desc()).limit(n)
    return low.withColumn("share", pct(F.col("revenue"), prod.agg(F.sum("revenue")).scalar()))


def mid_date(df: DataFrame):
    """Scalar subquery: min + (max − min) / 2 in epoch microseconds (the mid
    point may fall mid-day)."""
    lo, hi = wall_micros(F.min("date")), wall_micros(F.max("date"))
    return df.agg((lo + F.floor((hi - lo) / 2))).scalar()


def period_half_compare(df: DataFrame, dim: str, salesperson: bool = False, top: int | None = None) -> DataFrame:
    """Second half (date > mid) vs first half per ``dim``: current revenue and
    transactions, previous revenue (0 when absent), target = 110 % of current.
    Groups with no current rows vanish.  One conditional aggregate — no join
    between the halves."""
    require(df, "date", "revenue", dim)
    mid = mid_date(df)
    us = wall_micros(F.col("date"))
    x = df.where(F.col(dim).isNotNull() & F.col("date").isNotNull())
    cur = us > mid
    out = x.groupBy(dim).agg(
        F.coalesce(F.sum(F.when(cur, F.col("revenue"))), F.lit(0.0)).alias("revenue"),
        F.count(F.when(cur, F.col("revenue"))).alias("transactions"),
        F.count_if(cur).alias("_cur_rows"),
        F.coalesce(F.sum(F.when(~cur, F.col("revenue"))), F.lit(0.0)).alias("revenue_prev"),
    ).where(F.col("_cur_rows") > 0).drop("_cur_rows")
    out = out.withColumn("target", F.col("revenue") * F.lit(TARGET_UPLIFT))
    if salesperson:
        out = out.where(~F.lower(F.col(dim).cast("string")).isin(NON_SALESPERSON_NAMES))
    if top:
        out = out.orderBy(F.col("revenue").desc(), F.col(dim)).limit(top)
    return out


def growth_vs_prev(half: DataFrame, dim: str) -> DataFrame:
    """Growth %, share %, target achievement %, rank over a half comparison;
    the totals and the mean growth of groups with a previous value."""
    # one aggregate row for the totals; ranks come from the ordered scan, so no
    # task holds the whole dimension
    grown = half.withColumn("growth_pct", F.coalesce(
        pct(F.col("revenue") - F.col("revenue_prev"), F.col("revenue_prev")), F.lit(0.0)))
    totals = grown.agg(F.sum("revenue").alias("total_revenue"), F.sum("revenue_prev").alias("total_revenue_prev"),
                       F.avg(F.when(F.col("revenue_prev") > 0, F.col("growth_pct"))).alias("avg_growth_pct"))
    ranked = running_sum(grown, [F.col("revenue").desc(), F.col(dim).asc()], "revenue", "_running", "rank").drop("_running")
    out = ranked.join(F.broadcast(totals))   # a single row
    out = out.withColumn("share_pct", pct(F.col("revenue"), F.col("total_revenue")))
    if "target" in half.columns:
        out = out.withColumn("achievement_pct", pct(F.col("revenue"), F.col("target")))
    return out


def growth_dim(df: DataFrame, dim: str, freq: str = "M", top_n: int = 10) -> DataFrame:
    """Last vs previous period for the ``top_n`` values of ``dim`` by total
    revenue.  Missing → 0; growth = 100 when prev = 0 < curr, 0 when both 0."""
    require(df, "date", "revenue", dim)
    g = (df.where(F.col("date").isNotNull() & F.col(dim).isNotNull())
           .groupBy(period_start(F.col("date"), freq).alias("period"), dim)
           .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue")))
    top = (g.groupBy(dim).agg(F.sum("revenue").alias("_tot"))
            .orderBy(F.col("_tot").desc(), F.col(dim)).limit(top_n).select(dim))
    periods = g.select("period").distinct()
    w = Window.orderBy(F.col("period").desc())     # distinct periods: bounded
    last2 = periods.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= 2)
    n_periods = periods.agg(F.count(F.lit(1))).scalar()
    cur = g.join(F.broadcast(last2), "period").groupBy(dim).agg(
        F.sum(F.when(F.col("_p") == 1, F.col("revenue"))).alias("curr"),
        F.sum(F.when(F.col("_p") == 2, F.col("revenue"))).alias("prev"))
    # top has at most top_n rows: a proven bound for the broadcast
    out = F.broadcast(top).join(cur, dim, "left").na.fill(0.0, ["curr", "prev"])
    out = out.where(n_periods >= 2)
    return out.withColumn("growth_pct",
                          F.when(F.col("prev") > 0, (F.col("curr") - F.col("prev")) / F.col("prev") * 100)
                           .when(F.col("curr") > 0, F.lit(100.0)).otherwise(F.lit(0.0)))


def dim_period_heatmap(df: DataFrame, dim: str, freq: str = "M", top_n: int = 10) -> DataFrame:
    """dim × period revenue, zero-filled, for the ``top_n`` values of ``dim``
    by row sum — in long form (dim, period, revenue); pivoting the handful of
    rows for display is a client concern."""
    require(df, "date", "revenue", dim)
    g = (df.where(F.col("date").isNotNull() & F.col(dim).isNotNull())
           .groupBy(dim, period_start(F.col("date"), freq).alias("period"))
           .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue")))
    top = (g.groupBy(dim).agg(F.sum("revenue").alias("_tot"))
            .orderBy(F.col("_tot").desc(), F.col(dim)).limit(top_n).select(dim))
    # the sorted distinct periods as one array (bounded by the calendar span)
    periods = g.agg(F.sort_array(F.collect_set("period"))).scalar()
    grid = top.withColumn("period", F.explode(periods))
    return grid.join(g, [dim, "period"], "left").na.fill(0.0, ["revenue"])


def region_monthly(df: DataFrame, region: str = "region", top: int = 6) -> DataFrame:
    """Monthly revenue of the ``top`` regions by total revenue."""
    require(df, "date", "revenue", region)
    g = (df.where(F.col("date").isNotNull() & F.col(region).isNotNull())
           .groupBy(period_start(F.col("date"), "M").alias("month"), region)
           .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue")))
    tops = (g.groupBy(region).agg(F.sum("revenue").alias("_tot"))
             .orderBy(F.col("_tot").desc(), F.col(region)).limit(top).select(region))
    return g.join(F.broadcast(tops), region, "left_semi")
