"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``.

A step whose result is read several times, or whose lineage must end, is
written as Parquet there and read again: executors may be lost afterwards, the
files stay, and the next plan knows the table's size.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` below the session's checkpoint folder and read it back; in
    at most ``files`` files when the caller knows that it is small."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/salescope-llm/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


#: Tables written inside the ``passing`` blocks that are open.
_SCOPES: list[list[DataFrame]] = []


@contextmanager
def passing():
    """Tables written inside are deleted at the end of the block, but for those
    given to the function it yields; these belong to the block around it."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _SCOPES.append([])
    try:
        yield keep
    finally:
        paths = {df._llm_path for df in kept}
        for df in _SCOPES.pop():
            if df._llm_path not in paths:
                drop(df)
            elif _SCOPES:
                _SCOPES[-1].append(df)


def drop(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    path = getattr(df, "_llm_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Arrow batches of few rows while an action runs whose rows hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
