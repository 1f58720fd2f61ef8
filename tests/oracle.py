"""Compare a Spark query with its DuckDB oracle (row count, column names,
order-insensitive values) — the same gate the build driver applies."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).to_pydatetime().replace(tzinfo=None)
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    if hasattr(v, "item"):
        return _cell(v.item())
    if isinstance(v, bool):
        return v
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_cell(v) for v in rec))
    return out


def _key(row):
    return tuple((0, "") if v is None else (1, repr(round(v, 3)) if isinstance(v, float) else repr(v)) for v in row)


def _eq(a, b, tol):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        try:
            a, b = float(a), float(b)
        except (TypeError, ValueError):
            return False
        return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
    if isinstance(a, bool) or isinstance(b, bool):
        return bool(a) == bool(b)
    return a == b


def compare(spark_df, duck_pdf: pd.DataFrame, tol: float = 1e-9) -> tuple[bool, str]:
    spdf = spark_df.toPandas()
    sc, dc = sorted(spdf.columns), sorted(duck_pdf.columns)
    if sc != dc:
        return False, f"columns differ: spark={sc} oracle={dc}"
    if len(spdf) != len(duck_pdf):
        return False, f"row count differs: spark={len(spdf)} oracle={len(duck_pdf)}"
    a = sorted(_rows(spdf), key=_key)
    b = sorted(_rows(duck_pdf), key=_key)
    for i, (ra, rb) in enumerate(zip(a, b)):
        for c, x, y in zip(sc, ra, rb):
            if not _eq(x, y, tol):
                return False, f"row {i} column {c}: spark={x!r} oracle={y!r}"
    return True, f"{len(a)} rows"
