"""Product codes of vectors, with assignment along a trie of distinct parts.

Components become integers, floor(scale * x), and a vector is cut into equal
consecutive parts.  Each part position has a codebook; it starts as that part
of the rows with the smallest ids, and a round assigns every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and moves
every entry to the componentwise floor(sum / count) of its parts; an entry
without parts stays.  All arithmetic is in integers, so results do not depend
on the partitioning.

The assignment: a task takes the distinct parts of ``SLICE`` vectors at a
position, in lexicographic order, with their multiplicities.  They are the
leaves of a trie whose levels are the dimensions.  The traversal is depth
first: it carries the distances to all entries, accumulated along the path
from the root, and a node adds its own dimension's squared differences to its
parent's vector once for all leaves below it.  ``BLOCK`` consecutive leaves
are visited together, level by level, continuing the path of the block before,
so that memory is bounded by the block.  A leaf takes the argmin; sums of its
part weighted by its multiplicity go to its entry.

Nothing but sums is shuffled: a task sends one row for each position, entry
and dimension, whatever the number of vectors.  What comes to the driver and
goes to the tasks is the codebooks (parts x entries x dimensions of a part).

Edge cases: rows whose vector is null or holds a null or non-finite component
are dropped.  Vectors of other lengths are filled with zeros up to the next
multiple of the number of parts that the longest kept vector needs (an empty
vector is all zeros).  Among rows of one id the smaller vector comes first into
the codebook, null ids come last; fewer rows than entries give fewer entries.
An empty table gives no rows.  Components of any size are exact (integers
beyond 2^28 are handled without a fixed width, more slowly); an error or a sum
beyond a long is null.  Repeated rows are rows of their own.  Input columns
named like an appended one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import materialize
from .textmap import col, without

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose parts share a trie, and leaves that are visited together.
SLICE = 1 << 15
BLOCK = 1 << 12
#: Below this magnitude all distances fit 64 bits (divided by the dimensions of a part).
_NARROW = 1 << 28
#: Sums leave a task in digits of this many bits, so that they add up as longs.
_DIGIT = 40


def usable(vector):
    """Not null, and no null or non-finite component."""
    ok = F.forall(F.transform(vector, lambda x: x.cast("double")),
                  lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(ok, F.lit(False))


# -- integers ----------------------------------------------------------------

def integers(column: pa.Array, width: int, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column, filled with zeros to ``width``; of
    Python integers where 64 bits might not do for parts of ``dim``."""
    off = np.asarray(column.offsets, dtype=np.int64)
    flat = np.asarray(column.values, dtype=np.float64)[off[0]:off[-1]]
    size = np.diff(off)
    x = np.zeros((len(size), width))
    x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    if len(flat) and np.abs(flat).max() * scale >= _NARROW / dim:
        exact = [scale * int(v) + int(np.floor(scale * (v - int(v)))) for v in x.ravel().tolist()]
        return np.array(exact, dtype=object).reshape(x.shape)
    return np.floor(scale * x).astype(np.int64)


# -- the trie ----------------------------------------------------------------

def distinct(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, leaf of each row, multiplicities)."""
    order = np.lexsort(part.T[::-1])
    rows = part[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    leaf = np.empty(len(rows), np.int64)
    leaf[order] = np.cumsum(new) - 1
    return rows[new], leaf, np.diff(np.r_[np.flatnonzero(new), len(rows)])


def nearest(leaves: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every leaf, by a depth-first traversal of
    the trie of the lexicographically ordered distinct rows ``leaves``."""
    n, d = leaves.shape
    same = np.zeros((n, d), bool)
    same[1:] = leaves[1:] == leaves[:-1]
    common = np.logical_and.accumulate(same, axis=1).sum(axis=1)  # levels shared with the leaf before
    entry, distance = np.empty(n, np.int64), np.empty(n, leaves.dtype)
    zero = np.zeros(len(book), leaves.dtype)
    path = [zero] * (d + 1)  # accumulated distances along the path to the last leaf visited
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        above, at = path[0][None, :], np.zeros(hi - lo, np.int64)  # a level's vectors, each leaf's node
        for level in range(d):
            fresh = common[lo:hi] <= level
            first = np.flatnonzero(fresh)
            step = leaves[lo + first, level][:, None] - book[None, :, level]
            here = above[at[first]] + step * step
            node = np.cumsum(fresh) - 1
            if not fresh[0]:  # the first leaves are below the last node of the block before
                here, node = np.concatenate([path[level + 1][None, :], here]), node + 1
            above, at, path[level + 1] = here, node, here[-1]
        best = np.argmin(above, axis=1)
        entry[lo:hi] = best[at]
        distance[lo:hi] = above[np.arange(len(above)), best][at]
    return entry, distance


@dataclass
class Books:
    """Codebooks: an array (entries, dimensions of a part) for each position."""

    books: list[np.ndarray]
    width: int
    scale: int

    def sha256(self) -> str:
        """Of all entries' decimal components by position, entry, dimension."""
        numbers = ",".join(str(int(v)) for b in self.books for v in b.ravel().tolist())
        return hashlib.sha256(numbers.encode()).hexdigest()

    def slices(self, column: pa.Array) -> Iterator[tuple[int, list[tuple]]]:
        """For runs of vectors: (rows, per position (leaves, leaf of each row,
        multiplicities, entry and distance of each leaf))."""
        dim = self.width // len(self.books)
        for lo in range(0, len(column), SLICE):
            x = integers(column.slice(lo, SLICE), self.width, dim, self.scale)
            wide = x.dtype == object or any(b.dtype == object for b in self.books)
            out = []
            for p, book in enumerate(self.books):
                part = x[:, p * dim:(p + 1) * dim]
                if wide:
                    part, book = part.astype(object), book.astype(object)
                leaves, leaf, times = distinct(part)
                out.append((leaves, leaf, times, *nearest(leaves, book)))
            yield len(x), out


def _book(rows: list[list[int]]) -> np.ndarray:
    wide = any(abs(v) >= _NARROW / max(1, len(r)) for r in rows for v in r)
    return np.array(rows, dtype=object if wide else np.int64)


# -- Spark jobs --------------------------------------------------------------

_SUMS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()),
                      T.StructField("dim", T.IntegerType()), T.StructField("digit", T.IntegerType()),
                      T.StructField("value", T.LongType())])


def _digits(value: int) -> Iterator[tuple[int, int]]:
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & ((1 << _DIGIT) - 1):
            yield k, sign * (value & ((1 << _DIGIT) - 1))
        value, k = value >> _DIGIT, k + 1


def sums(vectors: DataFrame, vector_col: str, model: Books) -> dict[tuple[int, int, int], int]:
    """Sum of the parts assigned to every entry, by (part, entry, dimension);
    dimension -1 is their number."""
    shipped = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Books = shipped.value
        total: dict[tuple[int, int], list] = {}
        for column in _gathered(batches):
            for _, found in m.slices(column):
                for p, (leaves, _, times, entry, _) in enumerate(found):
                    weighted = leaves * times[:, None]
                    order = np.argsort(entry, kind="stable")
                    first = np.flatnonzero(np.diff(entry[order], prepend=-1))
                    here = np.add.reduceat(weighted[order], first, axis=0)
                    number = np.add.reduceat(times[order], first)
                    for e, s, c in zip(entry[order][first].tolist(), here.tolist(), number.tolist()):
                        old = total.get((p, e))
                        total[p, e] = [c, *s] if old is None else [a + b for a, b in zip(old, [c, *s])]
        rows = [(p, e, i - 1, k, v) for (p, e), s in total.items() for i, n in enumerate(s) for k, v in _digits(int(n))]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pydict(
                {f.name: [r[i] for r in rows[at:at + 10_000]] for i, f in enumerate(_SUMS.fields)},
                schema=pa.schema([(n, pa.int32()) for n in _SUMS.names[:4]] + [("value", pa.int64())]))

    rows = (vectors.select(col(vector_col)).mapInArrow(run, _SUMS)
            .groupBy("part", "entry", "dim", "digit").agg(F.sum("value").alias("value")).collect())
    out: dict[tuple[int, int, int], int] = {}
    for r in rows:  # at most parts x entries x (dimensions + 1) numbers of few digits each
        key = (r["part"], r["entry"], r["dim"])
        out[key] = out.get(key, 0) + (int(r["value"]) << (_DIGIT * r["digit"]))
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The batches' one column, joined to arrays of ``SLICE`` rows or more."""
    wait, n = [], 0
    for b in batches:
        wait.append(b.column(0))
        n += len(b)
        if n >= SLICE:
            yield pa.concat_arrays(wait)
            wait, n = [], 0
    if n:
        yield pa.concat_arrays(wait)


def fit(vectors: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS, scale: int = SCALE) -> Books | None:
    """Codebooks of the usable rows; None when there are none."""
    v = col(vector_col)
    rows = vectors.filter(usable(v)).select(col(id_col).alias("i"), v.cast("array<double>").alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    dim = max(1, -(-longest // parts))
    # the smallest ids with their vectors: at most ``entries`` rows
    first = rows.orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    start = pa.array([r["v"] for r in first], pa.list_(pa.float64()))
    whole = integers(start, dim * parts, dim, scale)
    model = Books([_book(whole[:, p * dim:(p + 1) * dim].tolist()) for p in range(parts)], dim * parts, scale)
    for _ in range(rounds):
        got = sums(rows, "v", model)
        books = []
        for p, b in enumerate(model.books):
            moved = b.tolist()
            for e in range(len(moved)):
                n = got.get((p, e, -1), 0)
                if n:
                    moved[e] = [got.get((p, e, i), 0) // n for i in range(dim)]
            books.append(_book(moved))
        model = Books(books, dim * parts, scale)
    return model


def encode(vectors: DataFrame, vector_col: str, model: Books, keep: list[str] | None = None) -> DataFrame:
    """The usable rows' columns ``keep`` with ``code`` (entries in part order,
    two hex digits each, or as many as the entries need) and ``error``
    (squared distances summed over the parts)."""
    shipped = vectors.sparkSession.sparkContext.broadcast(model)
    kept = without(vectors.select(*[col(c) for c in (keep if keep is not None else vectors.columns)]), ["code", "error"])
    source = (vectors.filter(usable(col(vector_col)))
              .select(*[col(c) for c in kept], col(vector_col).cast("array<double>").alias("__llm_vector")))
    schema = T.StructType([source.schema[i] for i in range(len(kept))]
                          + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = max(2, len(f"{max(len(b) for b in model.books) - 1:x}"))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Books = shipped.value
        table = [f"{e:0{digits}x}" for e in range(max(len(b) for b in m.books))]
        hexed = np.array(table, dtype=f"S{digits}")
        for b in batches:
            codes, errors = [], []
            for n, found in m.slices(b.column(len(kept))):
                code = np.stack([hexed[entry][leaf] for _, leaf, _, entry, _ in found], axis=1)
                codes += np.ascontiguousarray(code).view(f"S{digits * len(found)}").ravel().astype(str).tolist()
                error = reduce(np.add, [distance[leaf] for _, leaf, _, _, distance in found])
                errors += [e if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(kept)], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=names)

    return source.mapInArrow(run, schema)


ADDED = ["code", "error", "label_error", "codebooks_sha256"]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             keep: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> DataFrame:
    """One row per usable vector: the columns ``keep``, its ``code`` and
    ``error``, ``label_error`` (the errors summed over rows of one label, nulls
    together) and ``codebooks_sha256``."""
    model = fit(vectors, id_col, vector_col, parts, entries, rounds, scale)
    keep = without(vectors.select(*[col(c) for c in (keep if keep is not None else vectors.columns)]), ADDED)
    if model is None:
        types = dict(zip(ADDED, ("string", "long", "long", "string")))
        return vectors.limit(0).select(*[col(c) for c in keep], *[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    # the rows wait as a table: their errors are read for the sums and for the result
    named = vectors.select(*[col(c) for c in keep], col(label_col).alias("__llm_label"), col(vector_col).alias("__llm_vector"))
    coded = materialize(encode(named, "__llm_vector", model, keep=[*keep, "__llm_label"]), "vector-codes")
    # one row a label; Spark broadcasts them if their size allows it, else splits the label that many rows hold
    total = materialize(coded.groupBy(F.col("__llm_label").alias("__llm_of"))
                        .agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"),
                             F.count_if(F.col("error").isNull()).alias("lost")), "vector-label-errors")
    label_error = F.when(F.col("lost") == 0, F.expr("try_cast(s AS BIGINT)"))
    return (coded.join(total, F.col("__llm_label").eqNullSafe(F.col("__llm_of")), "left")
            .select(*[col(c) for c in keep], "code", "error", label_error.alias("label_error"),
                    F.lit(model.sha256()).alias("codebooks_sha256")))
