"""Registry of named queries over the test tables.

Each entry pairs a Spark plan builder ``fn(spark, sf_dir) -> DataFrame`` with
its oracle SQL (DuckDB dialect, over the raw tables) or ``None`` when the
operator is not expressible in SQL (models, iterative jobs).  Computed
columns carry the same names on both sides and doubles are rounded the same
way so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import sales_view, sales_view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Revenue amounts lie on a grid of 4 decimals, so their sums are rounded there;
# means, ratios and percentages get two digits more.
MONEY = 4
RATIO = 6


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def view(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return sales_view(spark, sf_dir, list(cols) if cols else None)


def with_sales(body: str, cols: list[str] | None = None) -> str:
    """SQL with the canonical view as CTE ``sales``; ``body`` may continue
    the WITH list by starting with a comma."""
    head = f"WITH sales AS (\n{sales_view_sql(cols)}\n)"
    body = body.strip()
    if body.startswith(","):
        return head + body + "\n"
    return head + "\n" + body + "\n"


def rnd(df: DataFrame, money: list[str] = (), ratio: list[str] = ()) -> DataFrame:
    cols = {c: F.round(F.col(c), MONEY) for c in money if c in df.columns}
    cols.update({c: F.round(F.col(c), RATIO) for c in ratio if c in df.columns})
    return df.withColumns(cols) if cols else df
