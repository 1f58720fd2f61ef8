"""Embedding near-dedup with cross-polytope hashing.

A vector is rotated (random signs and fast Hadamard transforms) and hashed to
the nearest signed axis; ``k`` such hashes make a bucket key.  Every vector is
put into its own bucket and into the next ones (multiprobe: the axes that lose
least), about ``2^k`` in all, in each of ``TABLES`` tables.  Two vectors at
cosine 0.95 share a bucket of one table with a probability of about 0.9, of
four tables 0.9999.  The last hash of a key may look at fewer axes, so that the
buckets grow with the rows put into them and no row meets more unrelated
vectors in a larger table.

Equal vectors are one class first, so copies cost one row each.  Buckets with
one member are left out before any vector is shuffled.  A bucket of more than
``BLOCK`` members is cut into blocks and its pairs of blocks go to different
groups, so no task gathers a whole hot bucket.  Within a group all cosines come
from matrix products in double precision.  A pair that shares several buckets
counts only in the one with the least key, which a task decides by itself: it
makes the keys of the members of linked pairs anew, table by table, until a
smaller one is shared.  So pairs are never written down: a group emits one row for each member (its links here, and the
least member of its local component).  Components follow from these stars.

Edge cases: vectors that are null, zero or hold null or non-finite components,
and rows without an id, link with nothing (component: their own id); vectors of
different lengths never link; rows that repeat an id are one node; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .components import components
from .tables import materialize, small_batches
from .textmap import col
from .vectors import matrices, power_of_two, rotation, valid

TABLES = 4
TABLE_BIT = 64 - (TABLES - 1).bit_length()  # the first bits of a key are its table
BLOCK = 2_000
SMALL = 64  # members of a group that is compared together with others
COSINE = 0.95
SEED = 20


class KeyShape(NamedTuple):
    """How bucket keys are made: hashes in a key, axes that the last of them
    looks at, buckets of a table that a vector is put into."""
    hashes: int
    last_axes: int
    probes: int


def key_shape(n_vectors: int, dim: int) -> KeyShape:
    """Shortest keys with 16 buckets or more in a table for each row that is
    put into it.  Keys of 64 probes settle for 16 buckets a vector: in few
    dimensions no key keeps unrelated vectors apart."""
    d = power_of_two(max(dim, 2))
    for k in range(2, 9):
        for last in (1 << i for i in range(1, d.bit_length())):
            shape = KeyShape(k, last, 3 << (k - 2) if last <= 4 and last < d else 1 << k)
            rows = n_vectors * (1 if shape.probes >= 64 and last == d else shape.probes)
            if 16 * rows <= (2 * d) ** (k - 1) * 2 * last:
                return shape
    return shape


def _largest(size: np.ndarray, best: int) -> np.ndarray:
    """Columns of the ``best`` largest values in each row, ties to the lower."""
    size, row, out = size.copy(), np.arange(len(size)), []
    for _ in range(best):
        out.append(size.argmax(axis=1))
        size[row, out[-1]] = -1.0
    return np.stack(out, axis=1)


def bucket_keys(x: np.ndarray, shape: KeyShape, tables: Sequence[int] = range(TABLES), seed: int = SEED) -> np.ndarray:
    """(rows, tables * probes) bucket keys of each vector: in every table its
    own bucket and the next ones.  Keys ascend with the table."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    n, dim = x.shape
    axes = [power_of_two(dim)] * (shape.hashes - 1) + [min(shape.last_axes, power_of_two(dim))]
    combos = np.array(list(itertools.product(*(range(min(3, a)) for a in axes))))
    out = []
    for t in tables:
        loss = np.zeros((n, len(combos)))
        sides = []
        for j, a in enumerate(axes):
            y = rotation(x, seed * 1_000 + t * 16 + j)[:, :a]
            size = np.abs(y)
            axis = _largest(size, min(3, a))
            high = np.take_along_axis(size, axis, 1)
            sides.append((axis * 2 + (np.take_along_axis(y, axis, 1) < 0)).astype(np.uint64))
            loss += ((high[:, :1] - high) ** 2)[:, combos[:, j]]
        order = np.argsort(loss, axis=1, kind="stable")[:, :shape.probes]
        code = np.full(order.shape, tb.mix(np.array([t + 1 + (dim << 20)], np.uint64))[0])
        for j, side in enumerate(sides):
            code = tb.mix(code * tb.U64(0x9E3779B97F4A7C15) + np.take_along_axis(side, combos[order, j], 1))
        out.append(code >> tb.U64(64 - TABLE_BIT) | tb.U64(t << TABLE_BIT))
    return np.concatenate(out, axis=1)


def _key_rows(classes: DataFrame, shape: KeyShape) -> DataFrame:
    schema = T.StructType([classes.schema["id"], T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in matrices(b.column(1)):
                for lo in range(0, len(rows), 2_000):
                    keys = bucket_keys(x[lo:lo + 2_000], shape)
                    at = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array(rows[lo:lo + 2_000])),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(tb.signed(keys.reshape(-1))))], names=["id", "keys"])

    return classes.select("id", "v").mapInArrow(run, schema)


def _local(linked: np.ndarray) -> np.ndarray:
    """Component number (least member) of each row of a link matrix."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def _group(key: np.uint64, across: bool, side: np.ndarray, weight: np.ndarray, x: np.ndarray, shape: KeyShape,
           cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, links, least member linked) of one group whose ids ascend."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    if across:  # two blocks of one bucket: only pairs across
        linked &= side[:, None] != side[None, :]
    # pairs that also share a bucket of a smaller key count there: most are gone after the first table
    some = np.arange(len(x))
    for t in range(int(key >> tb.U64(TABLE_BIT)) + 1):
        own = np.flatnonzero(linked.any(axis=1))
        some, linked = some[own], linked[np.ix_(own, own)]
        if len(some) == 0:
            break
        keys = bucket_keys(x[some], shape, [t])
        lower, count = np.unique(keys[keys < key], return_counts=True)
        lower = lower[count > 1]
        for lo in range(0, len(lower), 4_096):
            part = lower[lo:lo + 4_096]
            at = np.minimum(np.searchsorted(part, keys), len(part) - 1)
            member = np.zeros((len(some), len(part)), dtype=np.float32)
            r, c = np.nonzero(part[at] == keys)
            member[r, at[r, c]] = 1.0
            linked &= member @ member.T == 0
    own = np.flatnonzero(linked.any(axis=1))
    if len(own) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    label = _local(linked)
    return some[own], (linked[own] * weight[some][None, :]).sum(axis=1).astype(np.int64), some[label[own]]


def _small_groups(start: np.ndarray, size: np.ndarray, key: np.ndarray, across: np.ndarray, side: np.ndarray, weight: np.ndarray,
                  x: np.ndarray, shape: KeyShape, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many groups at once, row numbers for members: the pairs of
    all groups as arrays, bucket keys only for the members of a linked pair."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = []
    for s in np.unique(size):
        rows = start[size == s][:, None] + np.arange(s)
        g, i, j = np.nonzero(np.triu(unit[rows] @ unit[rows].transpose(0, 2, 1) >= cosine, 1))
        pairs.append(np.stack([rows[g, i], rows[g, j]]))
    a, b = np.concatenate(pairs, axis=1)
    meant = ~across[a] | (side[a] != side[b])
    a, b = a[meant], b[meant]
    # pairs that also share a bucket of a smaller key count there: most are gone after the first table
    table = (key >> tb.U64(TABLE_BIT)).astype(int)
    for t in range(TABLES):
        look = np.flatnonzero(table[a] >= t)
        if len(look) == 0:
            break
        some = np.union1d(a[look], b[look])
        keys = bucket_keys(x[some], shape, [t])
        first = np.ones(len(a), dtype=bool)
        step = 1 + (1 << 23) // keys.shape[1] ** 2
        for lo in range(0, len(look), step):
            at = look[lo:lo + step]
            p, q = (keys[np.searchsorted(some, e[at])] for e in (a, b))
            first[at] = ~((p[:, :, None] == q[:, None, :]).any(axis=2) & (p < key[a[at]][:, None])).any(axis=1)
        a, b = a[first], b[first]
    links = np.zeros(len(x), dtype=np.int64)
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])
    low = np.arange(len(x))
    while (low[a] != low[b]).any():
        least = np.minimum(low[a], low[b])
        for end in (a, b, low[a], low[b]):
            np.minimum.at(low, end, least)
        low = low[low]
    own = np.union1d(a, b)
    return own, links[own], low[own]


def _linked(rows: DataFrame, shape: KeyShape, cosine: float) -> DataFrame:
    """(id, links, low) of rows (key, bi, bj, side, id, weight, v) that are
    sorted by their group."""
    schema = T.StructType([rows.schema["id"], T.StructField("links", T.LongType()),
                           T.StructField("low", rows.schema["id"].dataType)])

    def starts(key, bi, bj):
        new = (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        return np.r_[0, np.flatnonzero(new) + 1]

    def flush(parts):
        """Rows of whole groups."""
        key, bi, bj, side, ids, weight, x = (np.concatenate(p) for p in zip(*parts))
        start = starts(key, bi, bj)
        size = np.diff(np.r_[start, len(key)])
        order = np.lexsort((ids, np.repeat(np.arange(len(start)), size)))
        side, ids, weight, x = side[order], ids[order], weight[order], x[order]
        few = size <= SMALL
        if few.any():
            found = _small_groups(start[few], size[few], key, bi != bj, side, weight, x, shape, cosine)
            yield ids[found[0]], found[1], ids[found[2]]
        for lo, n in zip(start[~few], size[~few]):
            at = slice(lo, lo + n)
            own, links, low = _group(key[lo], bi[lo] != bj[lo], side[at], weight[at], x[at], shape, cosine)
            yield ids[at][own], links, ids[at][low]

    def batches_of(parts):
        for columns in flush(parts):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}  # by vector length: members of a group have one length, it is part of the key
        for b in batches:
            cols = [np.asarray(b.column(i)) for i in range(6)]
            cols[0] = cols[0].view(np.uint64)
            for rows_, x in matrices(b.column(6)):
                own = [c[rows_] for c in cols] + [x]
                kept = held.setdefault(x.shape[1], [])
                # the last group may go on in the next batch
                last = starts(*own[:3])[-1]
                if kept and last == 0 and all(kept[-1][c][-1] == own[c][0] for c in range(3)):
                    kept.append(own)
                    continue
                if kept or last:
                    yield from batches_of(kept + [[c[:last] for c in own]])
                held[x.shape[1]] = [[c[last:] for c in own]]
        for kept in held.values():
            yield from batches_of(kept)

    return rows.mapInArrow(run, schema)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                 block: int = BLOCK) -> DataFrame:
    """Per row of ``df``: id, ``n_links``, ``component_id`` and ``kept``."""
    v = col(vector_col)
    base = df.select(col(id_col).alias("id"), v.alias("v")).withColumn("ok", F.col("id").isNotNull() & valid(F.col("v")))
    hashed = materialize(base.select(
        "id", F.when(F.col("ok"), F.xxhash64("v", F.lit(1))).alias("h1"), F.when(F.col("ok"), F.xxhash64("v", F.lit(2))).alias("h2")),
        "vectors-hashed")
    # one row for each different vector; several rows of one id count once
    classes = materialize(base.filter("ok").groupBy("v").agg(F.min("id").alias("id"), F.countDistinct("id").alias("weight"))
                          .withColumns({"h1": F.xxhash64("v", F.lit(1)), "h2": F.xxhash64("v", F.lit(2))}), "vectors-classes")
    stats = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).head()
    shape = key_shape(stats["n"], stats["d"] or 2)
    one = _key_rows(classes, shape).select("id", F.explode("keys").alias("key"))
    shared = materialize(one.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "vectors-buckets")
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    placed = (one.join(shared, "key").withColumn("parts", parts)
              .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
                      (F.col("own") > F.col("other")).alias("side"), "id"))
    rows = (placed.join(classes.select("id", "weight", "v"), "id")
            .select("key", "bi", "bj", F.col("side").cast("int").alias("side"), "id", "weight", "v")
            .repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj"))
    with small_batches(df.sparkSession, 4_000):
        found = materialize(_linked(rows, shape, cosine), "vectors-linked")
    group = materialize(components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))), "vectors-components")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = materialize(
        classes.select("h1", "h2", "id", "weight").join(links, "id", "left")
        .join(group, F.col("id") == F.col("node"), "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component_id")), "vectors-named")
    out = hashed.join(named, ["h1", "h2"], "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
