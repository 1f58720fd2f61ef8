"""File sources and sinks.

Readers detect the format from the extension, test the text encoding of every
file on all its bytes (Spark replaces undecodable bytes silently instead of
failing, so the test replaces the try-and-retry of single-machine readers), and
union several uploads by column name; an upload that cannot be read is skipped
with its reason.  Sinks write every analysis result as
its own CSV / Parquet folder and the conformed table partitioned by month.
"""

from __future__ import annotations

import os
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SUPPORTED = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".pq": "parquet"}
UNSUPPORTED_HERE = {".xlsx": "excel", ".xls": "excel"}


def detect_format(path: str) -> str:
    """csv / json / parquet by extension; anything else is an error."""
    p = path.lower().rstrip("/")
    for ext, fmt in SUPPORTED.items():
        if p.endswith(ext):
            return fmt
    for ext, fmt in UNSUPPORTED_HERE.items():
        if p.endswith(ext):
            raise ValueError(f"{fmt} files are not read on the cluster; export {path} as CSV or Parquet")
    raise ValueError(f"unsupported file format: {path}")


def latin_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(files that are valid UTF-8, files that are not) below ``path``: one
    distributed pass over all bytes, one row per file comes back."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("ok"))
    rows = lines.groupBy("file").agg(F.bool_and("ok").alias("ok")).collect()
    names = {r["file"]: r["ok"] is not False for r in rows}
    return ([unquote(f) for f in sorted(names) if names[f]], [unquote(f) for f in sorted(names) if not names[f]])


def _read_csv(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    reader = (spark.read.option("header", True).option("inferSchema", True).option("quote", '"').option("escape", '"')
              .option("multiLine", multiline))
    utf8, latin = latin_files(spark, path)
    if not latin:
        return reader.csv(path)
    # ISO-8859-1 decodes any byte
    parts = [reader.option("encoding", "ISO-8859-1").csv(latin)]
    if utf8:
        parts.append(reader.option("encoding", "UTF-8").csv(utf8))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _json_is_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0]["value"].lstrip().startswith("[")


def load_data(spark: SparkSession, path: str, file_type: str | None = None, multiline: bool = False) -> DataFrame:
    """Read one upload: CSV (header, inferred types, doubled quotes, encoding
    by file), JSON (an array of records or JSON lines) or Parquet.

    ``multiline`` lets quoted CSV cells hold line breaks; a file is then read
    by one task, as is a JSON array.  For large data use one record per line."""
    fmt = file_type or detect_format(path)
    if fmt == "csv":
        return _read_csv(spark, path, multiline)
    if fmt == "json":
        return spark.read.option("multiLine", _json_is_array(spark, path)).json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {fmt}")


def read_uploads(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """(union of the readable uploads by column name, missing → null; or None,
    reasons of the skipped ones by path)."""
    frames, skipped = [], {}
    for p in paths:
        try:
            frames.append(load_data(spark, p))
        except (ValueError, PySparkException, Py4JJavaError) as e:
            skipped[p] = str(e).splitlines()[0][:200]
    if not frames:
        return None, skipped
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), skipped


def union_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Concatenate uploads with the union of their columns; files that cannot
    be read are skipped (``read_uploads`` says why)."""
    df, skipped = read_uploads(spark, paths)
    if df is None:
        raise ValueError(f"no readable file: {skipped}")
    return df


def write_bundle(results: dict[str, DataFrame], out_dir: str, fmt: str = "csv") -> dict[str, str]:
    """Write every non-empty result to ``out_dir/<name>`` (CSV with header or
    Parquet); empty results are skipped.  Returns {name: path}.  Each result
    is computed once: the row count comes with the write."""
    written = {}
    for name, df in results.items():
        if df is None:
            continue
        path = os.path.join(out_dir, name)
        seen = Observation()
        w = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.parquet(path)
        if seen.get["n"]:
            written[name] = path
        else:
            _delete(df.sparkSession, path)
    return written


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_processed(df: DataFrame, path: str, partition_col: str = "year_month") -> None:
    """Store the conformed table for later jobs, partitioned by month so that
    date filters prune whole folders."""
    if partition_col not in df.columns and "date" in df.columns:
        df = df.withColumn(partition_col, F.date_format("date", "yyyy-MM"))
    df.write.mode("overwrite").partitionBy(partition_col).parquet(path)


def reread(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: what many jobs share is
    computed once."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def preview(df: DataFrame, order: list, n: int = 10) -> DataFrame:
    """The first ``n`` rows in ``order`` (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)
