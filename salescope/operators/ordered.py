"""Ordered operators over transaction-sized tables.

A window ``OVER (ORDER BY …)`` without ``PARTITION BY`` moves every row into
one task.  The operators here give the same answers with the work spread
over range buckets:

1. ``repartitionByRange`` on the full ordering key, sort inside each bucket,
   tag rows with their bucket and cut the lineage with a reliable
   ``checkpoint()`` (so a lost executor recomputes the same buckets); the lags
   write blocks of rows instead (``Blocks``), compressed and by columns;
2. one narrow pass (``mapInPandas``) summarises every bucket in a few rows:
   its count, its last *k* values, its last non-null value or its sum;
3. the driver folds those bucket summaries in order (bounded: buckets × k
   rows) into the state carried into each bucket;
4. a second narrow pass finishes every bucket with its carried-in state.

The ordering key must be total (ties broken by enough columns) so that the
result does not depend on the partitioning.  Apart from the range shuffle,
nothing is shuffled, and no task holds more than its own bucket.

``exact_quantiles`` finds linear-interpolated quantiles (numpy/pandas
"linear", DuckDB ``quantile_cont``) without buffering all values of a column
in one task: it narrows value intervals with ``percentile_approx`` and counts
until the interval around each target rank is small, then ranks only that
interval.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir, store

BUCKET = "_bucket"
#: A block has at most so many rows, and so many bytes unless it is a single
#: row: a batch of Spark's Parquet reader is 4,096 blocks.
BLOCK, BLOCK_BYTES = 32, 16 << 10
PIECE = 1024                # blocks that a task unpacks at once


def _sort_cols(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def stage_ordered(df: DataFrame, order: list) -> DataFrame:
    """Range-partition ``df`` by ``order``, sort each bucket, tag bucket ids and
    checkpoint.  Bucket ids ascend with the ordering key."""
    ensure_checkpoint_dir(df.sparkSession)
    cols = _sort_cols(order)
    staged = (df.repartitionByRange(*cols)
                .sortWithinPartitions(*cols)
                .withColumn(BUCKET, F.spark_partition_id()))
    return staged.checkpoint(eager=True)


def _summaries(staged: DataFrame, fn, schema: str) -> pd.DataFrame:
    """Run ``fn`` (iterator of pandas batches → summary rows) on every bucket
    and return the bounded per-bucket summary table sorted by bucket."""
    rows = staged.mapInPandas(fn, schema).collect()
    pdf = pd.DataFrame([r.asDict() for r in rows])
    if pdf.empty:
        return pdf
    return pdf.sort_values("b").reset_index(drop=True)


# ---------------------------------------------------------------------------
# lags and rolling statistics
# ---------------------------------------------------------------------------

class Blocks:
    """A table in ``order``, written as blocks of up to ``BLOCK`` rows: a column
    is an array, a row of the table is a block.  A block holds its bucket, its
    number there and the last ``k`` values before it in the bucket, so wherever
    a reader splits the files, a block's lags follow from it and from the ends
    of the buckets before.

    ``spread`` tells that equal order keys of ``df`` share a partition and that
    its partitions ascend with ``order``."""

    def __init__(self, df: DataFrame, order: list, value: str, k: int, spread: bool = False):
        cols = _sort_cols(order)
        rows = (df if spread else df.repartitionByRange(*cols)).sortWithinPartitions(*cols)
        self.fields, self.k, self.at = df.schema.fields, k, df.columns.index(value)
        schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()),
                               T.StructField("before", T.ArrayType(T.DoubleType())),
                               *[T.StructField(f"c{i}", T.ArrayType(f.dataType)) for i, f in enumerate(self.fields)]])
        at, most, room = self.at, BLOCK, BLOCK_BYTES

        def pack(it):
            block, past = 0, np.zeros(0)
            for b in it:
                if not b.num_rows:
                    continue
                values = np.concatenate([past, _floats(b.column(at))])
                size = max(1, min(most, room * b.num_rows // max(b.nbytes, 1)))
                first = np.arange(0, b.num_rows, size)
                end = first + len(past)
                n = np.minimum(end, k)
                ends = np.cumsum(n)
                before = values[np.arange(ends[-1]) + np.repeat(end - ends, n)]
                places = pa.array(np.append(first, b.num_rows).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), b.column(b.num_columns - 1)[0].as_py(), np.int32)),
                     pa.array(np.arange(block, block + len(first))),
                     pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(before)),
                     *[pa.ListArray.from_arrays(places, c) for c in b.columns[:-1]]], names=schema.names)
                block, past = block + len(first), values[-k:]

        self.stored = store(rows.withColumn(BUCKET, F.spark_partition_id()).mapInArrow(pack, schema))

    def rows(self, *names: str) -> DataFrame:
        """These columns of all rows."""
        at = [[f.name for f in self.fields].index(c) for c in names]
        return self.stored.select(F.inline(F.arrays_zip(*[F.col(f"c{i}") for i in at]))).toDF(*names)

    def carried(self) -> dict[int, list]:
        """The last ``k`` values before each bucket (from the last block of each:
        one row a bucket is broadcast and collected)."""
        values = F.concat("before", F.col(f"c{self.at}").cast("array<double>"))
        last = F.broadcast(self.stored.groupBy("bucket").agg(F.max("block").alias("block")))
        out, past = {}, []
        for r in sorted(self.stored.join(last, ["bucket", "block"]).select("bucket", values.alias("v")).collect()):
            out[r["bucket"]] = past
            past = (past + [math.nan if x is None else x for x in r["v"]][-self.k:])[-self.k:]
        return out

    def lags(self, lags, window: int, names: list[str]) -> DataFrame:
        """All rows with their lags, rolling mean and deviation as ``names``."""
        carry, k, at, piece = self.carried(), self.k, self.at, PIECE
        schema = T.StructType([*self.fields, *[T.StructField(c, T.DoubleType()) for c in names]])

        def finish(it):
            for whole in it:
                for i in range(0, whole.num_rows, piece):
                    b = whole.slice(i, piece)
                    bucket, block, before = b.columns[:3]
                    bucket, block = bucket.to_numpy(), block.to_numpy()
                    columns = [c.flatten() for c in b.columns[3:]]
                    values = _floats(columns[at])
                    starts = np.append(0, np.cumsum(b.column(3 + at).value_lengths().to_numpy()))
                    # blocks that follow each other go together
                    runs = np.flatnonzero(np.append(True, (np.diff(bucket) != 0) | (np.diff(block) != 1)))
                    new = [[] for _ in names]
                    for r, end in zip(runs, [*runs[1:], len(bucket)]):
                        past = (carry[int(bucket[r])] + before[r].as_py())[-k:]
                        x = pd.Series(np.concatenate([np.asarray(past, "float64"), values[starts[r]:starts[end]]]))
                        roll = x.rolling(window)
                        for to, y in zip(new, [*[x.shift(n) for n in lags], roll.mean(), roll.std()]):
                            to.append(y.iloc[len(past):].to_numpy())
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.concatenate(y), from_pandas=True) for y in new]],
                                                     names=schema.names)

        return self.stored.mapInArrow(finish, schema)


def _floats(values: pa.Array) -> np.ndarray:
    return values.to_pandas().astype("float64").to_numpy()


def row_blocks(df: DataFrame, order: list, value: str, lags=(1, 7), window: int = 7, spread: bool = False) -> Blocks:
    """``df`` written for its ``row_lags``; see ``Blocks``."""
    return Blocks(df, order, value, max(max(lags), window), spread)


def row_lags(df: DataFrame | Blocks, order: list, value: str, lags=(1, 7), window: int = 7,
             prefix: str | None = None) -> DataFrame:
    """Add ``{prefix}_lag_{k}``, ``{prefix}_rolling_mean_{w}`` and
    ``{prefix}_rolling_std_{w}`` computed over the whole table in ``order``
    (or over its ``row_blocks``).

    Rolling statistics need ``window`` rows (null before), std is the sample
    standard deviation — the pandas ``shift``/``rolling`` semantics.
    """
    prefix = prefix or value
    blocks = df if isinstance(df, Blocks) else row_blocks(df, order, value, lags, window)
    return blocks.lags(lags, window, [*[f"{prefix}_lag_{n}" for n in lags], f"{prefix}_rolling_mean_{window}",
                                      f"{prefix}_rolling_std_{window}"])


# ---------------------------------------------------------------------------
# forward fill
# ---------------------------------------------------------------------------

def forward_fill(df: DataFrame, order: list, cols: list[str]) -> DataFrame:
    """Replace nulls in ``cols`` by the last non-null value above (in ``order``).

    Built-in functions only, so every column type keeps its values exactly:
    inside a bucket a running ``last`` fills, and what a bucket inherits is the
    last value of the buckets before it (one row per bucket, joined by bucket)."""
    staged = stage_ordered(df, order)
    cols_order = _sort_cols(order)
    inside = Window.partitionBy(BUCKET).orderBy(*cols_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = staged.withColumns({f"_f{i}": F.last(F.col(c), ignorenulls=True).over(inside) for i, c in enumerate(cols)})
    ends = filled.withColumn("_n", F.row_number().over(
        Window.partitionBy(BUCKET).orderBy(*cols_order))).groupBy(BUCKET).agg(
        *[F.max_by(f"_f{i}", "_n").alias(f"_e{i}") for i in range(len(cols))])
    # one row per bucket, as many as there are range partitions
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(BUCKET, *[F.last(f"_e{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(cols))])
    out = filled.join(carry, BUCKET)
    return out.select(*[F.coalesce(F.col(f"_f{cols.index(c)}"), F.col(f"_c{cols.index(c)}")).alias(c) if c in cols else F.col(c)
                        for c in df.columns])


# ---------------------------------------------------------------------------
# running sums / ranks
# ---------------------------------------------------------------------------

def running_sum(df: DataFrame, order: list, value: str, out: str,
                rank: str | None = None, total: str | None = None) -> DataFrame:
    """Add the running sum of ``value`` (and optionally the 1-based row rank
    and the grand total) in ``order`` —
    ``SUM() OVER (ORDER BY … ROWS UNBOUNDED PRECEDING)``."""
    staged = stage_ordered(df, order)

    def total_of_bucket(it):
        b, n, s = None, 0, 0.0
        for pdf in it:
            if pdf.empty:
                continue
            b = int(pdf[BUCKET].iloc[0])
            n += len(pdf)
            s += float(pdf[value].astype("float64").fillna(0).sum())
        if b is not None:
            yield pd.DataFrame({"b": [b], "n": [n], "s": [s]})

    summ = _summaries(staged.select(BUCKET, value), total_of_bucket, "b int, n long, s double")
    carry: dict[int, tuple] = {}
    acc_n, acc_s = 0, 0.0
    for r in summ.itertuples():
        carry[int(r.b)] = (acc_n, acc_s)
        acc_n += int(r.n)
        acc_s += float(r.s)

    fields = staged.schema.fields + [T.StructField(out, T.DoubleType())]
    if rank:
        fields.append(T.StructField(rank, T.LongType()))
    schema = T.StructType(fields)
    grand_total = acc_s

    def finish(it):
        state = None
        for pdf in it:
            if pdf.empty:
                continue
            if state is None:
                state = carry.get(int(pdf[BUCKET].iloc[0]), (0, 0.0))
            n0, s0 = state
            cs = pdf[value].astype("float64").fillna(0).cumsum() + s0
            pdf[out] = cs.to_numpy()
            if rank:
                pdf[rank] = np.arange(n0 + 1, n0 + len(pdf) + 1, dtype="int64")
            state = (n0 + len(pdf), float(cs.iloc[-1]))
            yield pdf

    result = staged.mapInPandas(finish, schema).drop(BUCKET)
    if total:
        result = result.withColumn(total, F.lit(float(grand_total)))
    return result


# ---------------------------------------------------------------------------
# exact quantiles
# ---------------------------------------------------------------------------

LOCAL_RANK_LIMIT = 50_000   # an interval this small is ranked in one task
ACCURACY = 10_000           # percentile_approx accuracy used to bracket a rank


def exact_quantiles(df: DataFrame, col: str | Column, qs: list[float]) -> list[float | None]:
    """Linear-interpolated quantiles of a numeric column (nulls and NaN ignored)."""
    return joint_quantiles(df, {"v": (col, qs)})["v"]


def joint_quantiles(df: DataFrame, wanted: dict[str, tuple[str | Column, list[float]]]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several columns at once, nulls and NaN
    ignored: {name: (column, quantiles)} -> {name: values}.

    Scales with the table: a narrowing round is two single-row aggregates for
    all columns and all ranks (partial aggregation, no row shuffle).  The first
    brackets every rank that is still open between two approximate percentiles
    of its interval, the second counts the rows below them; the interval left
    around a rank shrinks about ``ACCURACY / 4`` fold per round.  Intervals of at
    most ``LOCAL_RANK_LIMIT`` rows are ranked, all in one job.  Hot values
    collapse into a single-value interval.  So the number of passes does not
    depend on the number of columns or quantiles.
    """
    names = list(wanted)
    cols = {}
    for i, name in enumerate(names):
        c = wanted[name][0]
        c = (F.col(c) if isinstance(c, str) else c).cast("double")
        cols[name] = F.when(~F.isnan(c), c).alias(f"v{i}")
    v = df.select(*cols.values()).persist()
    try:
        counts = v.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]).first()
        ranks: dict[tuple[str, int], int] = {}
        for i, name in enumerate(names):
            n = counts[f"n{i}"]
            for q in wanted[name][1] if n else []:
                ranks[f"v{i}", int(math.floor(q * (n - 1)))] = n
                ranks[f"v{i}", int(math.ceil(q * (n - 1)))] = n
        found = _select_ranks(v, ranks)
    finally:
        v.unpersist()
    out = {}
    for i, name in enumerate(names):
        n = counts[f"n{i}"]
        values = []
        for q in wanted[name][1]:
            pos = q * (n - 1)
            lo, hi = int(math.floor(pos)), int(math.ceil(pos))
            if n:
                a, b = found[f"v{i}", lo], found[f"v{i}", hi]
            values.append((float(a + (pos - lo) * (b - a)) if hi != lo else float(a)) if n else None)
        out[name] = values
    return out


def _select_ranks(v: DataFrame, ranks: dict[tuple[str, int], int]) -> dict[tuple[str, int], float]:
    """Value at each (column, 0-based ascending rank); ``ranks`` has the number
    of values of the column."""
    # per rank: (lower bound, upper bound, rows below the interval, rows inside)
    state = {k: (None, None, 0, n) for k, n in ranks.items()}
    result: dict[tuple[str, int], float] = {}
    margin = 2.0 / ACCURACY
    while True:
        open_ = [k for k in state if k not in result and state[k][3] > LOCAL_RANK_LIMIT]
        if not open_:
            break
        # ranks in one interval share a sketch
        intervals: dict[tuple, list] = {}
        for k in open_:
            intervals.setdefault((k[0], state[k][0], state[k][1]), []).append(k)
        aggs = []
        for i, ((c, lo, hi), ks) in enumerate(intervals.items()):
            shares = []
            for k in ks:
                q = (k[1] - state[k][2]) / max(state[k][3] - 1, 1)
                shares += [max(0.0, q - margin), min(1.0, q + margin)]
            aggs.append(F.percentile_approx(F.when(_inside(c, lo, hi), F.col(c)), shares, ACCURACY).alias(f"p{i}"))
        prow = v.agg(*aggs).first()
        around = {k: [float(x) for x in prow[f"p{i}"][2 * j:2 * j + 2]]
                  for i, ks in enumerate(intervals.values()) for j, k in enumerate(ks)}
        counts = []
        for i, k in enumerate(open_):
            lo, hi, _, _ = state[k]
            pl, ph = around[k]
            inside = _inside(k[0], lo, hi)
            # the middle serves where the percentiles do not narrow the interval
            counts += [F.count_if(inside & (F.col(k[0]) < F.lit(pl))).alias(f"lt{i}"),
                       F.count_if(inside & (F.col(k[0]) <= F.lit(ph))).alias(f"le{i}"),
                       F.count_if(inside & (F.col(k[0]) <= F.lit(pl + (ph - pl) / 2))).alias(f"mid{i}")]
        crow = v.agg(*counts).first()
        for i, k in enumerate(open_):
            lo, hi, below, inside = state[k]
            pl, ph = around[k]
            lt, le, low = crow[f"lt{i}"], crow[f"le{i}"], crow[f"mid{i}"]
            local = k[1] - below
            if lt <= local < le:
                if pl == ph:
                    result[k] = pl
                elif le - lt == inside:
                    mid = pl + (ph - pl) / 2
                    state[k] = ((lo, ("le", mid), below, low) if local < low
                                else (("gt", mid), hi, below + low, inside - low))
                else:
                    state[k] = (("ge", pl), ("le", ph), below + lt, le - lt)
            elif local < lt:
                state[k] = (lo, ("lt", pl), below, lt)
            else:
                state[k] = (("gt", ph), hi, below + le, inside - le)
    return result | _rank_small(v, {k: state[k] for k in state if k not in result})


def _inside(c: str, lo, hi) -> Column:
    cond = F.lit(True)
    if lo is not None:
        op, x = lo
        cond = cond & (F.col(c) > F.lit(x) if op == "gt" else F.col(c) >= F.lit(x))
    if hi is not None:
        op, x = hi
        cond = cond & (F.col(c) < F.lit(x) if op == "lt" else F.col(c) <= F.lit(x))
    return cond


def _rank_small(v: DataFrame, small: dict) -> dict[tuple[str, int], float]:
    """Rank the rows of small intervals (at most ``LOCAL_RANK_LIMIT`` rows
    each), a window partition for every interval."""
    if not small:
        return {}
    intervals: dict[tuple, list] = {}
    for k, (lo, hi, below, _) in small.items():
        intervals.setdefault((k[0], lo, hi, below), []).append(k)
    rows, places = [], []
    for i, ((c, lo, hi, below), ks) in enumerate(intervals.items()):
        rows.append(F.when(_inside(c, lo, hi) & F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), F.col(c).alias("v"))))
        places.append((F.col("i") == i) & F.col("rn").isin([k[1] - below for k in ks]))
    each = v.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("x.*")
    ranked = each.withColumn("rn", F.row_number().over(Window.partitionBy("i").orderBy("v")) - 1)
    got = {(r["i"], r["rn"]): float(r["v"]) for r in ranked.where(reduce(lambda a, b: a | b, places)).collect()}
    return {k: got[i, k[1] - below] for i, ((_, _, _, below), ks) in enumerate(intervals.items()) for k in ks}


def quantile_row(df: DataFrame, col: str, qs: list[float], names: list[str]) -> DataFrame:
    """The quantiles as a one-row DataFrame (for joins into plans)."""
    vals = exact_quantiles(df, col, qs)
    spark = df.sparkSession
    schema = T.StructType([T.StructField(nm, T.DoubleType()) for nm in names])
    return spark.createDataFrame([tuple(vals)], schema)
