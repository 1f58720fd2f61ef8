"""Approximate nearest neighbours along shifted space-filling curves.

Largest inner product becomes nearest neighbour in the usual way: every
candidate gets one more component, sqrt(M^2 - |x|^2) with M the largest norm,
every query a zero.  For each of ``CURVES`` orderings the vectors are projected
to ``DIMS`` random directions, shifted by a random offset and given their
Hilbert index (``BITS`` bits a direction).  Spark range-partitions the rows of
all orderings by (curve, key); a row's rank on its curve comes from its place
in its partition and the partitions' sizes.  Every ``block`` consecutive ranks
are packed into one row of bytes.

A query takes the blocks of its own key's neighbourhood, ``w`` on either side,
on every curve; their candidates are merged and reranked by the exact inner
product in double precision.  ``w`` is not guessed: the true neighbours of
``SAMPLE`` queries are found in one pass over all rows, and ``w`` is the least
window in which ``RECALL`` of them lie.  When windows on all curves would read
more blocks than there are, one curve with a window over the whole of it is
used instead: the search is then exact, by blocks.

Packing sets the memory of a task (one block of candidates and one of queries
at a time).  Nothing but partition sizes, block counts and the sampled queries
comes to the driver.

Edge cases: vectors that are null, zero or hold null or non-finite components
and rows without an id take no part; vectors of each length are searched on
their own; a row that comes several times counts once; rows that repeat the query's id are not its candidates;
with fewer than ``k`` candidates all are returned; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textbytes as tb
from .tables import drop, materialize, small_batches
from .textmap import col
from .vectors import matrices, valid

CURVES = 4
DIMS, BITS = 8, 7
BLOCK = 8_192
#: Queries whose true neighbours set the window, and the share of these to reach.
SAMPLE, RECALL = 64, 0.97
SEED = 20
#: Scores that differ by less may come out in another order from a matrix product.
_EPS = 1e-9


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of rows of non-negative cell numbers, for all rows at once."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    top = np.uint64(1) << np.uint64(bits - 1)
    q = top
    while q > 1:
        low = q - np.uint64(1)
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - np.uint64(1)), turn)
        q >>= np.uint64(1)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | (x[i] >> np.uint64(b)) & np.uint64(1)
    return key


def curve_keys(x: np.ndarray, curve: int, longest: float, query: bool = False, seed: int = SEED) -> np.ndarray:
    """Keys of vectors on a curve."""
    rng = np.random.Generator(np.random.Philox(key=seed * 1_000 + curve))
    dims = min(DIMS, x.shape[1] + 1)
    basis, _ = np.linalg.qr(rng.normal(size=(x.shape[1] + 1, dims)))
    shift = rng.random(dims)
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, longest ** 2 - (x * x).sum(axis=1)))
    spread = longest * 3.0 / np.sqrt(x.shape[1] + 1) or 1.0  # about three deviations of a projection
    at = ((np.c_[x, rest] @ basis) / spread + 1.0) / 2.0 * ((1 << BITS) - 2) + shift
    return tb.signed(hilbert(np.clip(at, 0, (1 << BITS) - 1).astype(np.int64), BITS))


def _best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query row, candidate row, score) of the ``k`` best candidates of each
    query; the score is a plain sum of products, the same wherever the
    candidate stands."""
    out_q, out_c, out_s = [], [], []
    for lo in range(0, len(qid), 256):
        some, own = q[lo:lo + 256], qid[lo:lo + 256]
        s = some @ x.T
        s[own[:, None] == ids[None, :]] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(some), -np.inf)
        r, c = np.nonzero((s >= least[:, None] - _EPS * (1 + np.abs(least[:, None]))) & (s > -np.inf)
                          if s.shape[1] > k else s > -np.inf)
        exact = (some[r] * x[c]).sum(axis=1)
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        keep = nth < k
        out_q.append(r[keep] + lo)
        out_c.append(c[keep])
        out_s.append(exact[keep])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _top(found: DataFrame, k: int) -> DataFrame:
    """(q, rank, c, score): the ``k`` best of each query over all blocks."""
    by = Window.partitionBy("q")
    best = F.dense_rank().over(by.orderBy(F.desc("score"), "c"))  # equal rows, found twice, share a rank
    return (found.withColumn("rank", best).filter(F.col("rank") <= k)
            .groupBy("q", "rank").agg(F.first("c").alias("c"), F.first("score").alias("score")))


class _Index:
    """Packed blocks of every curve, and where each row stands."""

    def __init__(self, rows: DataFrame, longest: float, block: int, curves: int):
        schema = T.StructType([T.StructField("curve", T.IntegerType()), T.StructField("key", T.LongType()),
                               T.StructField("id", T.LongType()), T.StructField("is_query", T.BooleanType()), rows.schema["v"]])

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, x in matrices(b.column(2)):
                    part = b.take(pa.array(at))
                    for c in range(curves):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(at), c, np.int32)), pa.array(curve_keys(x, c, longest)), *part.columns],
                            names=schema.names)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, part = 0, TaskContext.get().partitionId()
            for b in batches:
                yield pa.RecordBatch.from_arrays([
                    *b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))],
                    names=[*schema.names, "part", "nth"])
                n += b.num_rows

        self.n = rows.count()
        spread = F.xxhash64("id")  # equal keys (copies) may lie in several partitions
        ranges = max(1, -(-self.n * curves // block))
        lined = (rows.mapInArrow(keyed, schema).repartitionByRange(ranges, "curve", "key", spread)
                 .sortWithinPartitions("curve", "key", spread)
                 .mapInArrow(counted, T.StructType([*schema.fields, T.StructField("part", T.IntegerType()),
                                                    T.StructField("nth", T.LongType())])))
        lined = materialize(lined, "search-lined")
        # one row for each partition: its first rank
        starts = (lined.groupBy("part").agg(F.count("*").alias("n"))
                  .withColumn("start", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "start"))
        # every curve has all n rows, so this is the rank on the row's own curve
        rank = f"(start + nth - curve * {self.n}L)"
        self.places = materialize(lined.join(starts, "part").select(
            "curve", F.expr(f"cast({rank} div {block} as int)").alias("block"), "id", "is_query", "v"), "search-places")
        drop(lined)
        self.blocks = -(-self.n // block)

    def pack(self, only_queries: bool, curves: int) -> DataFrame:
        """One row for each block of rows."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, last = [], None
            for b in batches:
                group = np.asarray(b.column(0), dtype=np.int64) << 32 | np.asarray(b.column(1), dtype=np.int64)
                for g in np.unique(group):
                    if last is not None and g != last:
                        yield _packed(last, held)
                        held = []
                    last = g
                    held.append(b.take(pa.array(np.flatnonzero(group == g))))
            if held:
                yield _packed(last, held)

        rows = self.places.filter(F.col("curve") < curves)
        if only_queries:
            rows = rows.filter("is_query")
        return (rows.select("curve", "block", "id", "v").repartition("curve", "block").sortWithinPartitions("curve", "block")
                .mapInArrow(run, "curve int, block int, ids binary, vectors binary"))


def _packed(group: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    ids = np.concatenate([np.asarray(b.column(2)) for b in held])
    x = np.concatenate([m for b in held for _, m in matrices(b.column(3))])
    return pa.RecordBatch.from_arrays([
        pa.array([int(group >> 32)], pa.int32()), pa.array([int(group & 0xFFFFFFFF)], pa.int32()),
        pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
        names=["curve", "block", "ids", "vectors"])


def _scored(pairs: DataFrame, k: int) -> DataFrame:
    """(q, c, score) from rows (qids, qvectors, ids, vectors)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qid, q, ids, x = (np.frombuffer(b.column(i)[r].as_buffer(), dtype=t)
                                  for i, t in enumerate((np.int64, np.float64, np.int64, np.float64)))
                rows, cand, score = _best(qid, q.reshape(len(qid), -1), ids, x.reshape(len(ids), -1), k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[rows]), pa.array(ids[cand]), pa.array(score)],
                                                 names=["q", "c", "score"])

    return pairs.mapInArrow(run, "q long, c long, score double")


def _true_neighbours(rows: DataFrame, sample: list, k: int) -> DataFrame:
    """(q, c) of the ``k`` nearest rows of the sampled queries, by one pass."""
    qid = np.array([r["id"] for r in sample], dtype=np.int64)
    q = np.array([r["v"] for r in sample], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            for at, x in matrices(b.column(1)):
                r, c, score = _best(qid, q, ids[at], x, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids[at][c]), pa.array(score)],
                                                 names=["q", "c", "score"])

    return _top(rows.select("id", "v").mapInArrow(run, "q long, c long, score double"), k)


def window_for(index: _Index, rows: DataFrame, k: int, recall: float, sample: int) -> int:
    """Least window (blocks on either side) in which the share ``recall`` of
    the sampled queries' true neighbours lies on some curve."""
    some = rows.filter("is_query").orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample).select("id", "v").collect()
    if not some:
        return 0
    near = materialize(_true_neighbours(rows, some, k).select("q", "c"), "search-near")
    at = index.places.select("curve", "block", "id")
    wanted = at.join(near.select(F.col("q").alias("id")).union(near.select("c")).distinct(), "id")
    wanted = materialize(wanted, "search-wanted")
    gap = (near.join(wanted.select(F.col("id").alias("q"), "curve", F.col("block").alias("qb")), "q")
           .join(wanted.select(F.col("id").alias("c"), "curve", F.col("block").alias("cb")), ["c", "curve"])
           .groupBy("q", "c").agg(F.min(F.abs(F.col("qb") - F.col("cb"))).alias("gap")))
    # at most sample * k gaps, counted by size
    seen = sorted((r["gap"], r["n"]) for r in gap.groupBy("gap").agg(F.count("*").alias("n")).collect())
    total, so_far = sum(n for _, n in seen), 0
    for g, n in seen:
        so_far += n
        if so_far >= recall * total:
            return int(g)
    return 0


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
           block: int = BLOCK, curves: int = CURVES, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` rows of largest inner product with each row that fulfils
    ``is_query``: (query_id, rank, vec_id, score)."""
    base = df.select(col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
                     col(vector_col).alias("v")).filter(F.col("id").isNotNull() & valid(F.col("v")))
    # a row that comes several times counts once, so that copies take no places
    base = materialize(base.groupBy("id", "v").agg(F.max("is_query").alias("is_query")).select("id", "is_query", "v"), "search-rows")
    # one row for each length of vectors that has a query
    sizes = base.groupBy(F.size("v").alias("d")).agg(
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m"), F.max("is_query").alias("asked")) \
        .filter("asked").orderBy("d").collect()
    found = [_search(base.filter(F.size("v") == d), m, k, block, curves, recall, sample)
             for d, m, _ in sizes or [(0, 0.0, False)]]
    return reduce(DataFrame.union, found)


def _search(rows: DataFrame, longest: float, k: int, block: int, curves: int, recall: float, sample: int) -> DataFrame:
    """The search among rows (id, is_query, v) of one length."""
    index = _Index(rows, longest, block, curves)
    w = window_for(index, rows, k, recall, sample)
    if (2 * w + 1) * curves >= index.blocks:
        curves, w = 1, index.blocks  # the windows would cover the table: one curve, the whole of it
    with small_batches(rows.sparkSession, 16):
        packed = materialize(index.pack(False, curves), "search-blocks")
        queries = materialize(index.pack(True, curves), "search-queries")
        near = F.sequence(F.greatest(F.lit(0), F.col("block") - w), F.least(F.lit(index.blocks - 1), F.col("block") + w))
        asked = (queries.withColumn("to", F.explode(near))
                 .select(F.col("curve").alias("qc"), "to", F.col("ids").alias("qids"), F.col("vectors").alias("qvectors")))
        pairs = asked.join(packed, (F.col("qc") == F.col("curve")) & (F.col("to") == F.col("block")))
        found = materialize(_scored(pairs.select("qids", "qvectors", "ids", "vectors"), k), "search-found")
    return _top(found, k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                                 F.col("c").alias("vec_id"), "score")
