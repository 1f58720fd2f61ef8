"""Row features (calendar, price tier, product stats, transaction lags) and
the daily feature table used by the forecaster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import has
from .dims import product_features
from .ordered import exact_quantiles, row_blocks, row_lags

DAILY_FEATURES = [
    "year", "month", "quarter", "day_of_week", "day_of_month",
    "week_of_year", "is_weekend",
    "lag_1", "lag_7", "lag_14", "lag_30",
    "rolling_7", "rolling_14", "rolling_30", "rolling_std7", "trend_7",
]


def calendar_columns(date: Column) -> dict[str, Column]:
    dow = F.weekday(date)
    return {
        "year": F.year(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(date),
        "week_of_year": F.weekofyear(date),
        "is_weekend": (dow >= 5).cast("int"),
    }


def time_features(df: DataFrame) -> DataFrame:
    """year, month, quarter, weekday (Mon=0), day of month, ISO week,
    weekend flag, month name and 'yyyy-MM'."""
    if "date" not in df.columns:
        return df
    d = F.col("date")
    cols = calendar_columns(d)
    cols["month_name"] = F.date_format(d, "MMMM")
    cols["year_month"] = F.date_format(d, "yyyy-MM")
    return df.withColumns(cols)


def price_tier_expr(price: Column, q25: float | None, q75: float | None) -> Column:
    """Right-closed tiers (0,q25] Low, (q25,q75] Medium, (q75,∞) High; price
    ≤ 0 or edges that do not increase → NULL."""
    if q25 is None or q75 is None or not (0 < q25 < q75):
        return F.lit(None).cast("string")
    return (F.when(price <= 0, F.lit(None))
             .when(price <= q25, F.lit("Low"))
             .when(price <= q75, F.lit("Medium"))
             .when(price.isNotNull(), F.lit("High")))


def price_tier(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Tiers by the price quartiles of ``base`` (``df`` itself if not given)."""
    q25, q75 = exact_quantiles(df if base is None else base, "price", [0.25, 0.75])
    return df.withColumn("price_tier", price_tier_expr(F.col("price"), q25, q75))


def revenue_per_unit(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue_per_unit", F.try_divide(F.col("revenue"), F.col("quantity")))


MADE = ("year", "month", "quarter", "day_of_week", "day_of_month", "week_of_year", "is_weekend", "month_name", "year_month",
        "revenue_per_unit", "price_tier", "product_freq", "product_avg_revenue")


def lags_first(df: DataFrame, order: list | None = None) -> bool:
    """Whether ``feature_engineering`` writes the rows of ``df`` for the lags,
    before it makes other columns, and reads nothing else afterwards."""
    return has(df, "date", "revenue") and all(isinstance(c, str) and c in df.columns and c not in MADE for c in order or ["date"])


def feature_engineering(df: DataFrame, order: list | None = None, spread: bool = False) -> DataFrame:
    """All row features in the conforming order.  The lags come first where
    their order allows it, so that only the columns of ``df`` are sorted; the
    quartiles and the products' statistics are those of ``df``, read from the
    table written for the lags.  ``spread``: see ``ordered.Blocks``."""
    order = order or ["date"]
    own, rows, early, lagged, stats = df.columns, df.select, lags_first(df, order), [], []
    if early:
        blocks = row_blocks(df, order, "revenue", lags=(1, 7), window=7, spread=spread)
        df, rows = row_lags(blocks, order, "revenue", lags=(1, 7), window=7), blocks.rows
        lagged = [c for c in df.columns if c not in own]
    if "product" in own:   # before the columns that are made of a row: these are not shuffled
        known = df.columns
        df = product_features(df, rows(*[c for c in ("product", "revenue") if c in own]))
        stats = [c for c in df.columns if c not in known]
    df = time_features(df)
    if has(df, "price", "quantity"):
        df = revenue_per_unit(df)
        df = price_tier(df, rows("price"))
    df = df.select(*[c for c in df.columns if c not in (*stats, *lagged)], *stats, *lagged)
    if has(df, "date", "revenue") and not early:
        df = row_lags(df, order, "revenue", lags=(1, 7), window=7)
    return df


def daily_series(df: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Revenue per observed day (per series key when given)."""
    keys = list(series or [])
    return (df.where(F.col("date").isNotNull())
              .groupBy(*keys, F.to_date("date").alias("day"))
              .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))
              .withColumn("date", F.col("day").cast("timestamp_ntz")).drop("day"))


def daily_features(df: DataFrame, series: list[str] | None = None) -> DataFrame:
    """The forecaster's table: one row per observed day (per series), the
    calendar, lags 1/7/14/30, means of the previous 7/14/30 rows, std of the
    previous 7 (0 when undefined) and the slope of the previous 7 (0 below
    two rows); the first day of each series is dropped.

    The day table is bounded by the calendar; windows are partitioned by the
    series key when there is one."""
    keys = list(series or [])
    daily = daily_series(df, keys)
    w = Window.partitionBy(*keys).orderBy("date")
    prev = lambda n: w.rowsBetween(-n, -1)
    daily = daily.withColumn("_x", F.row_number().over(w).cast("double"))
    cols = calendar_columns(F.col("date"))
    cols.update({f"lag_{k}": F.lag("revenue", k).over(w) for k in (1, 7, 14, 30)})
    cols.update({f"rolling_{k}": F.avg("revenue").over(prev(k)) for k in (7, 14, 30)})
    cols["rolling_std7"] = F.coalesce(F.stddev_samp("revenue").over(prev(7)), F.lit(0.0))
    cols["trend_7"] = F.coalesce(F.regr_slope(F.col("revenue"), F.col("_x")).over(prev(7)), F.lit(0.0))
    out = daily.withColumns(cols).drop("_x")
    return out.where(F.col("lag_1").isNotNull()).select(*keys, "date", "revenue", *DAILY_FEATURES)
