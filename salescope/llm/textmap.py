"""Per-row text operators as one Arrow map over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb

_TEXT = "__llm_text"
#: Text that one output batch is made from (or the longest single text).
SLICE_BYTES = 4 << 20


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` whose names do not clash with ``names`` (Spark
    resolves names without case)."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in low]


def col(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def map_text(df: DataFrame, text_col: str, fields: T.StructType,
             make: Callable[[], Callable[[pa.Array], list[pa.Array]]], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the columns ``fields`` appended.

    ``make()`` runs once per task and returns a function from the batch's text
    column to one Arrow array per field.  A narrow step: no shuffle, a lost
    task is simply run again.  An input column that has the name of an
    appended one is replaced by it; a text column of another type is read as
    text.
    """
    kept = without(df.select(*[col(c) for c in keep]) if keep is not None else df, fields.names)
    types = {f.name: f for f in df.schema.fields}
    has_text = text_col in kept and isinstance(types[text_col].dataType, T.StringType)
    source = df.select(*[col(c) for c in kept], *([] if has_text else [col(text_col).cast("string").alias(_TEXT)]))
    at = kept.index(text_col) if has_text else len(kept)
    schema = T.StructType([types[c] for c in kept] + list(fields.fields))
    names, n_kept = schema.names, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            # slices of whole rows bound what a task holds of long texts
            for lo, hi, *_ in tb.chunks(batch.column(at), SLICE_BYTES):
                b = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*b.columns[:n_kept], *fn(b.column(at))], names=names)

    return source.mapInArrow(run, schema)
