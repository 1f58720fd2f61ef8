"""Small shared helpers for operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DIMENSION_CANDIDATES


def has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def resolve_column(df: DataFrame, dimension: str, candidates: list[str] | None = None) -> str | None:
    """First present column among the candidates for ``dimension``."""
    for c in candidates or DIMENSION_CANDIDATES.get(dimension, [dimension]):
        if c in df.columns:
            return c
    return None


def pct(num: Column, den: Column) -> Column:
    """num / den × 100 with NULL on a zero denominator (ANSI-safe)."""
    return F.try_divide(num, den) * F.lit(100.0)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named double columns (engine-independent comparisons)."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items() if c in df.columns})


def to_numeric(col: Column) -> Column:
    """Coerce to double; unparsable or null → 0 (ANSI-safe ``try_cast``)."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of the wall-clock value — the
    same in every session time zone (no daylight-saving gaps)."""
    day = F.unix_date(F.to_date(ts)).cast("long")
    secs = F.hour(ts) * 3600 + F.minute(ts) * 60
    frac = F.date_part(F.lit("SECOND"), ts).cast("decimal(10,6)") * 1_000_000
    return day * F.lit(86_400_000_000) + secs.cast("long") * F.lit(1_000_000) + frac.cast("long")


def days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end`` (pandas ``Timedelta.days``)."""
    return F.floor((wall_micros(end) - wall_micros(start)) / F.lit(86_400_000_000)).cast("long")


def period_start(date: Column, freq: str) -> Column:
    """Start of the day / ISO week (Monday) / month / year containing ``date``."""
    unit = {"D": "day", "W": "week", "M": "month", "Y": "year", "Q": "quarter"}[freq]
    return F.date_trunc(unit, date.cast("timestamp")).cast("timestamp_ntz")
