"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 20


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string")) % n


def draw(id_col: str) -> Column:
    """A number in 0 .. 2^20 - 1 that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(20)), F.lit(_RANGE))


def threshold(n: int, most: int) -> int:
    """``draw`` below this keeps about ``most`` of ``n`` rows (all, if fewer)."""
    return _RANGE if n <= most else max(1, int(_RANGE * most / n))
