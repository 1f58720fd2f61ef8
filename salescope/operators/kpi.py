"""Headline KPIs, data summary, text insights.

Every operator is one aggregate pass over the transactions (partial
aggregation on the map side), followed by work on tiny results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.fixed import DEFAULT_MARGIN_PCT, DIMENSION_CANDIDATES
from .common import days_between, has, pct, period_start
from .ordered import exact_quantiles, joint_quantiles


def kpis(df: DataFrame, revenue_source: DataFrame | None = None) -> DataFrame:
    """One row: totals, means, median revenue, distinct counts, date span.

    ``revenue_source`` may give the same revenue values from a narrower plan
    (e.g. the fact table alone when every lookup join keeps the row count);
    the exact median then reads only that plan."""
    aggs = []
    if has(df, "revenue"):
        aggs += [F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue"),
                 F.avg("revenue").alias("avg_revenue")]
    if has(df, "quantity"):
        aggs += [F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_quantity"),
                 F.avg("quantity").alias("avg_quantity")]
    aggs.append(F.count(F.lit(1)).alias("total_transactions"))
    if has(df, "product"):
        aggs.append(F.countDistinct("product").alias("unique_products"))
    if has(df, "customer"):
        aggs.append(F.countDistinct("customer").alias("unique_customers"))
    if has(df, "date"):
        aggs.append(days_between(F.min("date"), F.max("date")).alias("date_range_days"))
    median = None
    if has(df, "revenue"):
        (median,) = exact_quantiles(revenue_source if revenue_source is not None else df, "revenue", [0.5])
    return kpis_of(df.agg(*aggs), median)


def kpis_of(totals: DataFrame, median: float | None) -> DataFrame:
    """The ratios of a row of totals, and the median given."""
    out = totals
    if has(out, "total_revenue", "total_quantity"):
        out = out.withColumn("avg_order_value", F.try_divide("total_revenue", "total_transactions"))
    if has(out, "date_range_days"):
        total = F.col("total_revenue") if has(out, "total_revenue") else F.lit(0.0)
        out = out.withColumn("avg_daily_revenue", total / F.greatest(F.col("date_range_days"), F.lit(1)))
    if has(out, "total_revenue"):
        out = out.withColumn("median_revenue", F.lit(median).cast("double"))
    return out


def monthly_totals(df: DataFrame) -> DataFrame:
    """Month → revenue, quantity, rows, successful rows, cost (one pass)."""
    aggs = [F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
            F.count(F.lit(1)).alias("rows")]
    if has(df, "quantity"):
        aggs.append(F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"))
    if has(df, "is_successful_transaction"):
        aggs.append(F.count_if(F.col("is_successful_transaction")).alias("ok_rows"))
    elif has(df, "status", "revenue"):
        # success words per row; the "nothing matches anywhere → all
        # successful" rule is applied on the totals (no second scan)
        from .conform import success_match
        aggs.append(F.count_if(success_match(F.col("status"))).alias("hit_rows"))
    cost = next((c for c in DIMENSION_CANDIDATES["cost"] if c in df.columns), None)
    if cost:
        aggs.append(F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"))
    return df.groupBy(period_start(F.col("date"), "M").alias("month")).agg(*aggs)


def kpi_board(df: DataFrame, margin_pct: float = DEFAULT_MARGIN_PCT) -> DataFrame:
    """Dashboard board: revenue, quantity, successful transactions (from
    ``is_successful_transaction``, or derived from ``status`` in the same
    pass), AOV over
    successful ones, gross profit (cost column or flat margin), margin, MoM
    (needs two months) and YoY (needs thirteen).

    One aggregate over the transactions grouped by month (null months kept as
    their own group so totals include them), then a handful of rows.
    """
    m = monthly_totals(df)
    w = Window.orderBy(F.col("month").desc())  # months: a bounded table
    m = m.withColumn("_rn", F.when(F.col("month").isNotNull(), F.row_number().over(w)))
    has_cost = "cost" in m.columns
    has_ok = "ok_rows" in m.columns
    has_hits = "hit_rows" in m.columns
    has_qty = "quantity" in m.columns
    board = m.agg(
        F.sum("revenue").alias("total_revenue"),
        (F.sum("quantity") if has_qty else F.lit(0.0)).alias("total_quantity"),
        F.sum("rows").alias("total_transactions"),
        (F.sum("ok_rows") if has_ok else
         F.when(F.sum("hit_rows") > 0, F.sum("hit_rows")).otherwise(F.sum("rows")) if has_hits else
         F.sum("rows")).alias("successful_transactions"),
        (F.sum("cost") if has_cost else F.lit(None).cast("double")).alias("_cost"),
        F.count("_rn").alias("_months"),
        F.sum(F.when(F.col("_rn") == 1, F.col("revenue"))).alias("_m1"),
        F.sum(F.when(F.col("_rn") == 2, F.col("revenue"))).alias("_m2"),
        F.sum(F.when(F.col("_rn") == 13, F.col("revenue"))).alias("_m13"),
    )
    rev = F.col("total_revenue")
    gp = (rev - F.col("_cost")) if has_cost else rev * F.lit(margin_pct / 100.0)
    board = board.withColumns({
        "avg_order_value": F.coalesce(F.try_divide(rev, F.col("successful_transactions")), F.lit(0.0)),
        "gross_profit": gp,
    })
    board = board.withColumns({
        "margin_pct": F.coalesce(pct(F.col("gross_profit"), rev), F.lit(0.0)),
        "mom_pct": F.when(F.col("_months") >= 2,
                          F.coalesce(pct(F.col("_m1") - F.col("_m2"), F.col("_m2")), F.lit(0.0))),
        "yoy_pct": F.when(F.col("_months") >= 13,
                          F.coalesce(pct(F.col("_m1") - F.col("_m13"), F.col("_m13")), F.lit(0.0))),
    })
    return board.drop("_cost", "_months", "_m1", "_m2", "_m13")


def data_summary(df: DataFrame, numeric_quartiles: bool = True) -> DataFrame:
    """Long-form profile: one row per column with type, nulls, and for numeric
    columns count/mean/std/min/quartiles/max; plus table rows, columns and
    the date span.  One aggregate pass for all counts and moments; exact
    quartiles of all numeric columns in joint passes.
    """
    fields = [f for f in df.schema.fields]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(F.col(f.name).isNull()).alias(f"n{i}"))
    for i, f in enumerate(fields):
        if f.name in numeric:
            c = F.col(f.name).cast("double")
            aggs += [F.count(c).alias(f"c{i}"), F.avg(c).alias(f"a{i}"), F.stddev_samp(c).alias(f"s{i}"),
                     F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}")]
    if has(df, "date"):
        aggs += [F.min("date").alias("__dmin"), F.max("date").alias("__dmax")]
    row = df.agg(*aggs).first()
    spark = df.sparkSession
    filled = [f.name for i, f in enumerate(fields) if f.name in numeric and row[f"c{i}"]] if numeric_quartiles else []
    quartiles = joint_quantiles(df, {c: (c, [0.25, 0.5, 0.75]) for c in filled}) if filled else {}
    out = []
    for i, f in enumerate(fields):
        rec = {"column": f.name, "dtype": f.dataType.simpleString(), "missing": int(row[f"n{i}"]),
               "count": None, "mean": None, "std": None, "min": None, "q25": None, "q50": None,
               "q75": None, "max": None}
        if f.name in numeric:
            rec.update(count=int(row[f"c{i}"]), mean=row[f"a{i}"], std=row[f"s{i}"],
                       min=row[f"mn{i}"], max=row[f"mx{i}"])
            if f.name in quartiles:
                rec.update(zip(("q25", "q50", "q75"), quartiles[f.name]))
        out.append(rec)
    schema = T.StructType([
        T.StructField("column", T.StringType()), T.StructField("dtype", T.StringType()),
        T.StructField("missing", T.LongType()), T.StructField("count", T.LongType()),
        *[T.StructField(k, T.DoubleType()) for k in ["mean", "std", "min", "q25", "q50", "q75", "max"]],
    ])
    res = spark.createDataFrame([tuple(r[k] for k in schema.names) for r in out], schema)
    res = res.withColumns({"total_rows": F.lit(int(row["__rows"])).cast("long"),
                           "total_columns": F.lit(len(fields)).cast("long")})
    if has(df, "date"):
        dmin, dmax = row["__dmin"], row["__dmax"]
        res = res.withColumns({
            "date_min": F.lit(dmin.strftime("%Y-%m-%d") if dmin else None).cast("string"),
            "date_max": F.lit(dmax.strftime("%Y-%m-%d") if dmax else None).cast("string"),
            "span_days": F.lit((dmax - dmin).days if dmin and dmax else None).cast("long"),
        })
    return res


def weekend_uplift(df: DataFrame) -> DataFrame:
    """Mean revenue on weekend vs weekday rows and the uplift percent."""
    wd = F.weekday("date")
    out = df.agg(F.avg(F.when(wd >= 5, F.col("revenue"))).alias("weekend_avg"),
                 F.avg(F.when(wd < 5, F.col("revenue"))).alias("weekday_avg"))
    return out.withColumn("uplift_pct", (F.try_divide(F.col("weekend_avg"), F.col("weekday_avg")) - 1) * 100)
