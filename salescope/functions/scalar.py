"""Column expressions: number formatting, safe numerics, label encoding.

All are built-in Spark expressions (whole-stage codegen, no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES — suffix thresholds of the short number format.
SHORT_UNITS = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]
# FIXED VALUES — suffixes of the slide-deck format: T, M (milyar, 2 decimals),
# Jt (juta), K (no decimals).
DECK_UNITS = [(1e12, "T", 1), (1e9, "M", 2), (1e6, "Jt", 1), (1e3, "K", 0)]
CURRENCY_PREFIX = "Rp "


def _fixed(x: Column, digits: int) -> Column:
    """Fixed-point text with ``digits`` decimals of the value as it is."""
    return F.format_string(f"%.{digits}f", x)


def finite_or_zero(x: Column, fallback: float = 0.0) -> Column:
    """NULL, NaN and ±inf → ``fallback``."""
    d = x.cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(bad, F.lit(fallback)).otherwise(d)


def format_number(x: Column) -> Column:
    """1.2T / 3.4B / 5.6M / 7.8K with one decimal, plain integer below 1,000;
    non-numeric → '0'."""
    d = x.try_cast("double") if isinstance(x, Column) else F.lit(x).cast("double")
    expr = None
    for limit, suffix in SHORT_UNITS:
        piece = F.concat(_fixed(d / F.lit(limit), 1), F.lit(suffix))
        cond = F.abs(d) >= F.lit(limit)
        expr = F.when(cond, piece) if expr is None else expr.when(cond, piece)
    plain = F.format_number(d, 0)
    return F.when(d.isNull() | F.isnan(d), F.lit("0")).otherwise(expr.otherwise(plain))


def format_currency(x: Column) -> Column:
    """The short number format with the 'Rp ' prefix; non-numeric → 'Rp 0'."""
    return F.concat(F.lit(CURRENCY_PREFIX), format_number(x))


def format_deck(x: Column) -> Column:
    """Slide-deck money format; thresholds apply to the signed value, so
    negatives print in full.  Below 1,000 the value is rounded half-to-even."""
    d = x.try_cast("double")
    expr = None
    for limit, suffix, digits in DECK_UNITS:
        piece = F.concat(_fixed(d / F.lit(limit), digits), F.lit(suffix))
        cond = d >= F.lit(limit)
        expr = F.when(cond, piece) if expr is None else expr.when(cond, piece)
    plain = F.bround(d, 0).cast("long").cast("string")
    body = expr.otherwise(plain)
    return F.when(d.isNull() | F.isnan(d), F.lit(CURRENCY_PREFIX + "0")).otherwise(F.concat(F.lit(CURRENCY_PREFIX), body))


def label_encode(df: DataFrame, col: str, out: str | None = None, fitted: DataFrame | None = None) -> DataFrame:
    """Sorted distinct labels → 0-based index; unseen or null labels → 0.

    Indices are ranks of an ordered scan over the distinct labels and come back
    by a join: no label list on the driver, whatever its size."""
    from ..operators.ordered import running_sum

    out = out or f"{col}_encoded"
    src = fitted if fitted is not None else df
    labels = src.select(F.col(col).cast("string").alias("_label")).where(F.col("_label").isNotNull()).distinct()
    ranked = running_sum(labels.withColumn("_one", F.lit(1.0)), ["_label"], "_one", "_sum", "_rank")
    index = ranked.select("_label", (F.col("_rank") - 1).cast("double").alias("_index"))
    text = df.withColumn(col, F.col(col).cast("string"))
    return (text.join(index, text[col] == index["_label"], "left")
            .withColumn(out, F.coalesce("_index", F.lit(0.0))).drop("_label", "_index"))
