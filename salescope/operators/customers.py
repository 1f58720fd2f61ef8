"""Customer RFM analysis.

``rfm_base`` is one aggregate per customer (partial aggregation, then a
shuffle on the customer key).  Quintile edges are exact, linear-interpolated
quantiles computed by the distributed selector, and scoring is a plain
projection with the five edges as literals — no window over all customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import RFM_LOWEST_SEGMENT, RFM_SEGMENTS
from .common import days_between, require, resolve_column
from ..session import ensure_checkpoint_dir
from .ordered import joint_quantiles

QUINTILES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def rfm_base(df: DataFrame) -> DataFrame:
    """Per customer: recency (days from the customer's last date to the
    table's last date), frequency, monetary and average order."""
    cust = resolve_column(df, "customer")
    if cust is None:
        raise ValueError("no customer column")
    require(df, "date", "revenue")
    now = df.agg(F.max("date")).scalar()
    base = (df.where(F.col(cust).isNotNull()).groupBy(cust)
              .agg(F.max("date").alias("_last"),
                   F.count("revenue").alias("frequency"),
                   F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("monetary")))
    base = base.withColumn("recency", days_between(F.col("_last"), now)).drop("_last")
    if cust != "customer":
        base = base.withColumnRenamed(cust, "customer")
    return base.withColumn("avg_order", F.try_divide("monetary", "frequency"))


def _score(col: str, edges: list[float], descending: bool) -> F.Column:
    """qcut(q=5) bucket → score; all edges must be distinct, else 3."""
    if len(set(edges)) < len(edges) or any(e is None for e in edges):
        return F.lit(3)
    labels = [5, 4, 3, 2, 1] if descending else [1, 2, 3, 4, 5]
    c = F.col(col).cast("double")
    expr = F.when(c.isNull(), F.lit(None).cast("int"))
    expr = expr.when((c >= F.lit(edges[0])) & (c <= F.lit(edges[1])), F.lit(labels[0]))
    for i in range(1, 5):
        expr = expr.when((c > F.lit(edges[i])) & (c <= F.lit(edges[i + 1])), F.lit(labels[i]))
    return expr


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """Quintile scores: recency 5..1 (recent is better), frequency and
    monetary 1..5; any repeated quintile edge gives every row a 3."""
    # one row per customer, read by every round of the quantiles: written once
    # to the checkpoint folder (no cache left behind, lineage cut)
    ensure_checkpoint_dir(rfm.sparkSession)
    rfm = rfm.checkpoint(eager=True)
    out = rfm
    scored = {"recency": True, "frequency": False, "monetary": False}
    edges = joint_quantiles(rfm, {c: (c, QUINTILES) for c in scored})
    for col, desc in scored.items():
        out = out.withColumn(f"{col}_score", _score(col, edges[col], desc).cast("int"))
    return out.withColumn("rfm_score", F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score"))


def segment_of(score: F.Column) -> F.Column:
    expr = None
    for threshold, name in RFM_SEGMENTS:
        expr = F.when(score >= threshold, F.lit(name)) if expr is None else expr.when(score >= threshold, F.lit(name))
    return expr.otherwise(F.lit(RFM_LOWEST_SEGMENT))


def rfm(df: DataFrame) -> DataFrame:
    """Full RFM table with scores and segment names."""
    scored = rfm_scores(rfm_base(df))
    return scored.withColumn("segment", segment_of(F.col("rfm_score")))


def rfm_segments(rfm_df: DataFrame) -> DataFrame:
    """Customers and monetary per segment."""
    return rfm_df.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"),
                                         F.sum("monetary").alias("monetary"))


def top_customers(rfm_df: DataFrame, by: str = "monetary", n: int = 15) -> DataFrame:
    return rfm_df.orderBy(F.col(by).desc(), F.col("customer")).limit(n)


def recency_histogram(rfm_df: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram of recency (the maximum falls in the last bin)."""
    lo = rfm_df.agg(F.min("recency")).scalar()
    hi = rfm_df.agg(F.max("recency")).scalar()
    width = (hi - lo) / F.lit(float(bins))
    raw = F.when(width > 0, F.floor((F.col("recency") - lo) / width)).otherwise(F.lit(0))
    b = F.least(raw, F.lit(bins - 1)).cast("int")
    counts = rfm_df.where(F.col("recency").isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("customers"))
    spark = rfm_df.sparkSession
    # the bins table has a fixed size (``bins`` rows)
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = F.broadcast(grid).join(counts, "bin", "left").na.fill(0, ["customers"])
    return out.withColumns({"lower": lo + F.col("bin") * width,
                            "upper": lo + (F.col("bin") + 1) * width})
