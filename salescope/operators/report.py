"""Text insights and forecast summaries.

Every figure comes from an aggregate over the data; the sentences are
assembled with ``format_string`` / ``format_number`` column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir
from . import dims, growth
from .common import pct

# FIXED VALUES — forecast risk and action thresholds (percent).
RISK_HIGH_TREND, RISK_HIGH_WEEK = -15.0, -30.0
RISK_MEDIUM_TREND, RISK_MEDIUM_WEEK = -5.0, -15.0
ACTION_TREND_STRONG, ACTION_TREND_MILD = 15.0, 5.0
ACTION_WEEK_DROP = -20.0
ACTION_WEEKEND = 20.0
ACTION_VOLATILITY = 60.0
ACTION_VS_HISTORY = 10.0


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def _thousands(x: Column) -> Column:
    """1,234,567 (no decimals)."""
    return F.format_number(x, 0)


def insights(df: DataFrame) -> DataFrame:
    """Up to eight lines: totals, last month's change, best product, worst
    decliner, largest category, weekend uplift (only when higher).

    Returns (line_no, text).  The transactions are read once: sums by month,
    weekend flag, product and category are checkpointed, and every line is a
    small aggregate of these."""
    ensure_checkpoint_dir(df.sparkSession)
    dims_here = [c for c in ("product", "category") if c in df.columns]
    df = (df.groupBy(F.date_trunc("month", "date").cast("timestamp_ntz").alias("date"),
                     (F.weekday("date") >= 5).alias("weekend"), *dims_here)
            .agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("n"), F.count("revenue").alias("n_revenue"))
            .checkpoint(eager=True))
    tot = df.agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("rev"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    lines = [
        tot.select(F.lit(1).alias("line_no"), F.concat(F.lit("Total revenue: Rp "), _thousands(F.col("rev"))).alias("text")),
        tot.select(F.lit(2).alias("line_no"), F.concat(F.lit("Total transactions: "),
                                                       F.format_number(F.col("n"), 0)).alias("text")),
        tot.select(F.lit(3).alias("line_no"), F.concat(F.lit("Average order value: Rp "),
                                                       _thousands(F.col("rev") / F.col("n"))).alias("text")),
    ]
    g = growth.growth_metrics(df)
    last = g.orderBy(F.col("date").desc()).limit(1).where(F.col("revenue_mom").isNotNull())
    lines.append(last.select(F.lit(4).alias("line_no"), F.concat(
        F.lit("Revenue last month "), F.when(F.col("revenue_mom") > 0, F.lit("up ")).otherwise(F.lit("down ")),
        _fixed(F.abs(F.col("revenue_mom")), 1), F.lit("% (MoM)")).alias("text")))
    if "product" in df.columns:
        top = dims.top_products(df, 1, "revenue")
        lines.append(top.select(F.lit(5).alias("line_no"), F.concat(
            F.lit("Top product: "), F.col("product"), F.lit(" (Rp "), _thousands(F.col("revenue")), F.lit(")")
        ).alias("text")))
        dec = growth.declining_products(df).orderBy(F.col("decline_pct").desc(), F.col("product")).limit(1)
        lines.append(dec.select(F.lit(6).alias("line_no"), F.concat(
            F.lit("Warning: "), F.col("product"), F.lit(" fell "), _fixed(F.col("decline_pct"), 1),
            F.lit("% over the last 3 months")).alias("text")))
    if "category" in df.columns:
        cat = dims.category_analysis(df).orderBy(F.col("total_revenue").desc(), F.col("category")).limit(1)
        lines.append(cat.select(F.lit(7).alias("line_no"), F.concat(
            F.lit("Largest category: "), F.col("category"), F.lit(" ("), _fixed(F.col("revenue_pct"), 1),
            F.lit("% of total revenue)")).alias("text")))
    mean = lambda cond: F.try_divide(F.sum(F.when(cond, F.col("revenue"))), F.sum(F.when(cond, F.col("n_revenue"))))
    wk = df.agg(mean(F.col("weekend")).alias("we"), mean(~F.col("weekend")).alias("wd"))
    wk = wk.where(F.col("we").isNotNull() & F.col("wd").isNotNull() & (F.col("wd") > 0) & (F.col("we") > F.col("wd")))
    lines.append(wk.select(F.lit(8).alias("line_no"), F.concat(
        F.lit("Weekend revenue is "), _fixed((F.col("we") / F.col("wd") - 1) * 100, 1),
        F.lit("% higher than weekdays")).alias("text")))
    out = lines[0]
    for ln in lines[1:]:
        out = out.unionByName(ln)
    return out


def forecast_insights(fc: DataFrame, hist: DataFrame) -> DataFrame:
    """One row summarising a forecast (date, forecast) against the history
    (date, revenue): totals, best/worst day, trend between the halves,
    comparison with the last n history days, worst ISO week, weekend vs
    weekday, volatility and a risk level.  Both inputs are small (forecast
    horizon; one row per history day)."""
    w = Window.orderBy("date")
    f = fc.withColumn("_i", F.row_number().over(w) - 1)
    n = f.agg(F.count(F.lit(1))).scalar()
    first_half = f.agg(F.avg(F.when(F.col("_i") < F.floor(n / 2), F.col("forecast")))).scalar()
    second_half = f.agg(F.avg(F.when(F.col("_i") >= F.floor(n / 2), F.col("forecast")))).scalar()
    hw = Window.orderBy(F.col("date").desc())
    avg_hist = hist.withColumn("_r", F.row_number().over(hw)).where(F.col("_r") <= n).agg(F.avg("revenue")).scalar()
    weekly = f.groupBy(F.weekofyear("date").alias("week")).agg(F.avg("forecast").alias("wavg"))
    worst_week = weekly.agg(F.min_by("week", F.struct("wavg", "week"))).scalar()
    worst_avg = weekly.agg(F.min("wavg")).scalar()
    wd = F.weekday("date")
    row = f.agg(
        F.sum("forecast").alias("total_forecast"),
        F.avg("forecast").alias("avg_daily"),
        F.max_by("date", F.struct(F.col("forecast"), -F.col("_i"))).alias("max_day"),
        F.max("forecast").alias("max_forecast"),
        F.min_by("date", F.struct(F.col("forecast"), F.col("_i"))).alias("min_day"),
        F.min("forecast").alias("min_forecast"),
        F.avg(F.when(wd >= 5, F.col("forecast"))).alias("avg_weekend"),
        F.avg(F.when(wd < 5, F.col("forecast"))).alias("avg_weekday"),
        F.stddev_samp("forecast").alias("_sd"),
        F.count(F.lit(1)).alias("n_periods"),
    )
    zero_if = lambda num, den: F.coalesce(pct(num, den), F.lit(0.0))
    row = row.withColumns({
        "trend_pct": zero_if(second_half - first_half, first_half),
        "avg_hist": avg_hist,
        "vs_hist_pct": zero_if(F.col("avg_daily") - avg_hist, avg_hist),
        "worst_week": worst_week,
        "worst_week_avg": worst_avg,
        "worst_week_drop_pct": zero_if(worst_avg - F.col("avg_daily"), F.col("avg_daily")),
        "weekend_diff_pct": zero_if(F.col("avg_weekend") - F.col("avg_weekday"), F.col("avg_weekday")),
        "volatility_pct": zero_if(F.col("_sd"), F.col("avg_daily")),
    })
    row = row.withColumn("risk", F.when((F.col("trend_pct") < RISK_HIGH_TREND) | (F.col("worst_week_drop_pct") < RISK_HIGH_WEEK), F.lit("HIGH"))
                                  .when((F.col("trend_pct") < RISK_MEDIUM_TREND) | (F.col("worst_week_drop_pct") < RISK_MEDIUM_WEEK), F.lit("MEDIUM"))
                                  .otherwise(F.lit("LOW")))
    return row.drop("_sd")


def forecast_actions(ins: DataFrame) -> DataFrame:
    """Rule table over one insights row → (rule_no, level, action)."""
    t, wk, we = F.col("trend_pct"), F.col("worst_week_drop_pct"), F.col("weekend_diff_pct")
    vol, vh = F.col("volatility_pct"), F.col("vs_hist_pct")
    rules = [
        (1, t < -ACTION_TREND_STRONG, "URGENT", F.concat(F.lit("Sharp downward trend: revenue falls "), _fixed(F.abs(t), 1),
                                                          F.lit("% towards the end of the horizon"))),
        (1, (t >= -ACTION_TREND_STRONG) & (t < -ACTION_TREND_MILD), "WARNING",
         F.concat(F.lit("Moderate decline of "), _fixed(F.abs(t), 1), F.lit("% in the second half"))),
        (1, (t >= -ACTION_TREND_MILD) & (t > ACTION_TREND_STRONG), "OPPORTUNITY",
         F.concat(F.lit("Strong growth of "), _fixed(t, 1), F.lit("% expected"))),
        (1, (t >= -ACTION_TREND_MILD) & (t <= ACTION_TREND_STRONG) & (t > ACTION_TREND_MILD), "POSITIVE",
         F.concat(F.lit("Growth of "), _fixed(t, 1), F.lit("% detected"))),
        (2, wk < ACTION_WEEK_DROP, "WARNING", F.concat(F.lit("Possible drop in ISO week "), F.col("worst_week").cast("string"),
                                                       F.lit(": "), _fixed(F.abs(wk), 1), F.lit("% below the daily mean"))),
        (3, we > ACTION_WEEKEND, "PATTERN", F.concat(F.lit("Weekend revenue "), _fixed(we, 1), F.lit("% above weekdays"))),
        (3, (we <= ACTION_WEEKEND) & (we < -ACTION_WEEKEND), "PATTERN",
         F.concat(F.lit("Weekday revenue "), _fixed(F.abs(we), 1), F.lit("% above weekends"))),
        (4, vol > ACTION_VOLATILITY, "WARNING", F.lit("Extreme day-to-day volatility")),
        (5, vh < -ACTION_VS_HISTORY, "URGENT", F.concat(F.lit("Forecast "), _fixed(F.abs(vh), 1),
                                                         F.lit("% below the same number of past days"))),
        (5, (vh >= -ACTION_VS_HISTORY) & (vh > ACTION_VS_HISTORY), "POSITIVE",
         F.concat(F.lit("Forecast "), _fixed(vh, 1), F.lit("% above the same number of past days"))),
    ]
    def row(no, level, text):
        return F.struct(F.lit(no).alias("rule_no"), F.lit(level).alias("level"), text.alias("action"))

    # one pass over the insights row: the rules that hold, or the stable line
    hits = F.filter(F.array(*[F.when(cond, row(no, level, text)) for no, cond, level, text in rules]),
                    lambda x: x.isNotNull())
    stable = F.array(row(6, "STABLE", F.lit("No warning signal: keep the current plan and track actuals weekly")))
    return (ins.select(hits.alias("hits"))
            .select(F.explode(F.when(F.size("hits") > 0, F.col("hits")).otherwise(stable)).alias("r")).select("r.*"))
