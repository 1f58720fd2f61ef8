"""MinHash near-dedup with SuperMinHash signatures.

A document's set holds the hashes (64 bits) of its runs of ``shingle`` words,
or of all its words if there are fewer.

1. SuperMinHash: every element draws, for j = 0, 1, 2, ..., the j-th entry of
   its own random permutation of the signature's places and offers the value
   j + u there; a place keeps the least value offered.  Values of step j are
   below j + 1, so a document stops as soon as every place is filled: long
   texts after one or two steps.  Steps run over all documents of a chunk at
   once.
2. Equal sets are one class (set size and two 64-bit sums over the set), with
   the smallest id as its representative; from here on only representatives
   are handled, so thousands of copies cost one row each.
3. Banding: representatives that agree on all ``ROWS`` places of one of
   ``BANDS`` bands share a bucket.  At similarity 0.8 a pair shares one with a
   probability of 1 - 7e-5.
4. Verification on full sets.  A bucket's members are first compared with two
   of them (pivots, drawn by hash, so other ones in every bucket); links so
   found are merged by union-find (``components``).  Members of one component
   need no comparison, so a bucket that holds a huge group of near copies costs
   two pairs for each member instead of all pairs.  Where a bucket still spans
   several components, every member outside its main component is compared with
   all members, in groups of two blocks of at most ``BLOCK`` members: the sizes
   of all intersections come from one product of 0/1 matrices, and a group
   returns one link for each of its components that reaches a smaller one.
5. Components of the verified links; the smallest id of each stays.

Texts are read again only for documents that share a bucket.

Edge cases: documents without words, with null text or null id are linked with
nothing (component: their own id); rows that repeat an id are one node; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textbytes as tb
from .components import components
from .tables import drop, materialize, passing, small_batches
from .textmap import col

BANDS, ROWS = 24, 5
#: Members of one side of a group that is compared at once.
BLOCK = 1_000
#: Linked when 100 * common >= SIMILAR * union.
SIMILAR = 80


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every row, sorted by both."""
    data = tb.lower(data)
    s, e, row = tb.spans(data, off, tb.NOT_SPACE)
    rows = len(off) - 1
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    seq = tb.SequenceHash(tb.span_hash(data, s, e))
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    a = tb.ragged(first, count)
    at = np.repeat(np.arange(rows), count)
    h = seq.run(a, a + np.minimum(n, k)[at])
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    keep = np.r_[True, (np.diff(at) != 0) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return at[keep], h[keep]


def superminhash(row: np.ndarray, h: np.ndarray, rows: int, places: int) -> np.ndarray:
    """Signature (rows x places) of the sets given as (row, element); rows
    without elements stay infinite."""
    sig = np.full(rows * places, np.inf)
    live = np.arange(len(h))
    perm = None
    for j in range(places):
        if len(live) == 0:
            break
        r = tb.mix(h[live] + tb.U64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        swap = j + ((r >> tb.U64(40)).astype(np.int64) * (places - j) >> 24)
        value = j + (r & tb.U64((1 << 40) - 1)).astype(np.float64) / (1 << 40)
        if perm is None:
            place = swap  # the permutation is still the identity
        else:
            i = np.arange(len(live))
            place = perm[i, swap].astype(np.int64)
            perm[i, swap] = perm[i, j]
            perm[i, j] = place
        np.minimum.at(sig, row[live] * places + place, value)
        full = (sig.reshape(rows, places) < j + 1).all(axis=1)
        go = ~full[row[live]]
        if perm is None:
            first_swap = swap[go]
            live = live[go]
            perm = np.tile(np.arange(places, dtype=np.int16), (len(live), 1))
            i = np.arange(len(live))
            perm[i, first_swap] = 0
            perm[i, 0] = first_swap
        else:
            live, perm = live[go], perm[go]
    return sig.reshape(rows, places)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each row and band."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    key = np.tile(tb.mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), 1))
    for r in range(rows):
        key = tb.mix(key * tb.U64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, c1, c2, bands) of every row: set size, two sums over the set,
    bucket keys (none for an empty set)."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()),
                           T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off, _ in tb.chunks(b.column(1)):
                m = hi - lo
                row, h = shingle_sets(data, off, shingle)
                n = np.bincount(row, minlength=m)
                sums = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    total = np.r_[tb.U64(0), np.cumsum(tb.mix(h ^ tb.U64(salt)), dtype=np.uint64)]
                    end = np.cumsum(n)
                    sums.append(total[end] - total[end - n])
                keys = band_keys(superminhash(row, h, m, bands * rows), bands, rows)[n > 0]
                at = np.r_[0, np.cumsum((n > 0) * bands)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, m), pa.array(n.astype(np.int64)), pa.array(tb.signed(sums[0])),
                    pa.array(tb.signed(sums[1])),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(tb.signed(keys.reshape(-1))))], names=schema.names)

    return df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb"))
    schema = pairs.select("a", "b").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a = batch.column(0).to_pylist()
            ta, keep = batch.column(2), []
            for lo, hi, data, off, _ in tb.chunks(batch.column(3)):
                row, h = shingle_sets(data, off, shingle)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    if last is None or a[lo + r] != last:  # pairs come sorted by a
                        own, own_off, _ = tb.column_bytes(ta.slice(lo + r, 1))
                        last, left = a[lo + r], shingle_sets(own, own_off, shingle)[1]
                    right = h[cut[r]:cut[r + 1]]
                    at = np.searchsorted(left, right)
                    common = int((left[np.minimum(at, len(left) - 1)] == right).sum()) if len(left) else 0
                    keep.append(100 * common >= similar * (len(left) + len(right) - common) and common > 0)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with small_batches(pairs.sparkSession):
        return materialize(both.mapInArrow(run, schema), "minhash-links")


def _fits(similar: int):
    """Whether two set sizes allow the similarity."""
    return 100 * F.least("na", "nb") >= similar * F.greatest("na", "nb")


def _pairs(rows: DataFrame, similar: int) -> DataFrame:
    """Distinct (a, b), a < b, of rows (x, nx, y, ny)."""
    return (rows.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
                                        F.col("nx").alias("na"), F.col("ny").alias("nb"))
            .filter(_fits(similar)).groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"))


def _spread(mixed: DataFrame, block: int) -> DataFrame:
    """Members (k, id, c, main, n_main, n_other) of buckets that span several
    components, once for each group of two blocks: ``bi``, ``bj``.  Blocks of
    the main component meet only those of the others."""
    others, mains = (F.ceil(F.col(c) / F.lit(block)).cast("int") for c in ("n_other", "n_main"))
    own = F.when(F.col("c") == F.col("main"), others + F.pmod(F.xxhash64("id"), mains)).otherwise(
        F.pmod(F.xxhash64("id"), others)).cast("int")
    last = F.when(F.col("own") >= F.col("others"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    return (mixed.withColumns({"others": others, "mains": mains}).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
            .select("k", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "id", "c"))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets."""
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    values, count = np.unique(flat, return_counts=True)
    values = values[count > 1]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    row = np.repeat(np.arange(len(sets)), size)
    at = np.minimum(np.searchsorted(values, flat), max(len(values) - 1, 0))
    shared = np.flatnonzero(values[at] == flat) if len(values) else np.zeros(0, np.int64)
    order = shared[np.argsort(at[shared], kind="stable")]
    for lo in range(0, len(values), 4_096):
        some = order[np.searchsorted(at[order], lo):np.searchsorted(at[order], lo + 4_096)]
        m = np.zeros((len(sets), min(4_096, len(values) - lo)), dtype=np.float32)
        m[row[some], at[some] - lo] = 1.0
        out += m @ m.T
    return out


def _between(groups: DataFrame, shingle: int, similar: int) -> DataFrame:
    """Links (a, b) from components to the least one that they reach, in groups (k, bi, bj, id, c, t)
    that are sorted by (k, bi, bj)."""
    id_type = groups.schema["c"].dataType
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])

    def flush(held):
        ids, number = np.unique(np.array([i for c, _ in held for i in c]), return_inverse=True)
        sets = [x for _, x in held for x in x]
        common = _common(sets).astype(np.int64)  # exact below 2^24
        size = np.array([len(x) for x in sets])
        linked = 100 * common >= similar * (size[:, None] + size[None, :] - common)
        linked &= (number[:, None] != number[None, :]) & (common > 0)
        # the least component that links reach within the group, by rounds
        least = np.arange(len(ids))
        while True:
            near = np.where(linked, least[number][None, :], len(ids)).min(axis=1, initial=len(ids))
            found = least.copy()
            np.minimum.at(found, number, np.minimum(near, least[number]))
            found = found[found]
            if (found == least).all():
                break
            least = found
        moved = np.flatnonzero(least < np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[least[moved]].tolist(), b_type), pa.array(ids[moved].tolist(), b_type)],
                                          names=["a", "b"])

    b_type = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            key = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            c = b.column(4).to_pylist()
            for lo, hi, data, off, _ in tb.chunks(b.column(5)):
                row, h = shingle_sets(data, off, shingle)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                start = lo
                for r in range(lo, hi + 1):
                    if r == hi or key[r] != key[start]:
                        if last is not None and key[start] != last and held:
                            yield flush(held)
                            held = []
                        last = key[start]
                        held.append((c[start:r], [h[cut[q - lo]:cut[q - lo + 1]] for q in range(start, r)]))
                        start = r
        if held:
            yield flush(held)

    with small_batches(groups.sparkSession):
        return materialize(groups.select("k", "bi", "bj", "id", "c", "t").mapInArrow(run, schema), "minhash-between")


def links(classes: DataFrame, texts_of, shingle: int, similar: int, block: int = BLOCK) -> DataFrame:
    """Component (node, component) of the representatives that are linked."""
    one = classes.select(F.explode("bands").alias("k"), "id", "n")
    drawn = one.select("k", F.struct(F.xxhash64("k", "id").alias("draw"), "id", "n").alias("m"))
    shared = materialize(drawn.groupBy("k").agg(F.count("*").alias("size"), F.min("m").alias("low"), F.max("m").alias("high"))
                         .filter("size > 1"), "minhash-buckets")
    members = materialize(one.join(shared, "k").select("k", "size", "id", "n", "low", "high"), "minhash-members")
    texts = texts_of(members.groupBy("id").agg(F.lit(1).alias("one")).select("id"))
    with_pivot = lambda p: members.select(F.col("id").alias("x"), F.col("n").alias("nx"),
                                          F.col(f"{p}.id").alias("y"), F.col(f"{p}.n").alias("ny"))
    found = _verified(_pairs(with_pivot("low").union(with_pivot("high")), similar), texts, shingle, similar)
    group = materialize(components(found), "minhash-groups")
    # buckets of three and more whose members are still in different components
    named = (members.filter("size > 2").join(group, members["id"] == group["node"], "left")
             .select("k", "id", F.coalesce("component", "id").alias("c")))
    named = materialize(named, "minhash-named-members")
    spans = (named.groupBy("k", "c").agg(F.count("*").alias("n")).groupBy("k")
             .agg(F.count("*").alias("parts"), F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all"))
             .filter("parts > 1").select("k", F.col("top.c").alias("main"), F.col("top.n").alias("n_main"),
                                         (F.col("all") - F.col("top.n")).alias("n_other")))
    left = _spread(named.join(materialize(spans, "minhash-mixed"), "k"), block)
    rows = left.join(texts, "id").repartition("k", "bi", "bj").sortWithinPartitions("k", "bi", "bj")
    more = _between(rows, shingle, similar)
    if more.isEmpty():
        return group
    # stars of the first links and the new links together
    return components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    similar: int = SIMILAR) -> DataFrame:
    """Per row of ``df``: id, ``n_shingles``, ``component_id`` (the smallest id
    that links reach, itself included) and ``kept`` (whether that is its id)."""
    sig = materialize(signatures(df, id_col, text_col, shingle), "minhash-signatures")
    real = sig.filter("n > 0 and id is not null")
    classes = materialize(real.groupBy("n", "c1", "c2").agg(F.min("id").alias("id"), F.count("*").alias("rows"),
                                                            F.min_by("bands", "id").alias("bands")), "minhash-classes")

    def texts_of(ids: DataFrame) -> DataFrame:
        # one text for each id: rows that repeat an id count as one node
        return materialize(df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("t")).join(
            materialize(ids, "minhash-ids"), "id"), "minhash-texts")

    group = materialize(links(classes, texts_of, shingle, similar), "minhash-components")
    # every set's component: of its class, through the representative
    named = materialize(classes.select("n", "c1", "c2", "rows", "id").join(group, F.col("id") == F.col("node"), "left")
                        .withColumn("c", F.coalesce("component", "id")).filter("rows > 1 or c <> id")
                        .select("n", "c1", "c2", "c"), "minhash-named")
    out = (sig.select("id", "n", "c1", "c2").join(named, ["n", "c1", "c2"], "left")
           .withColumn("component_id", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("c", "id"))
                       .otherwise(F.col("id"))))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
             similar: int = SIMILAR) -> DataFrame:
    """``df`` with one document of each group of near copies; rows without an
    id stay."""
    with passing() as keep:
        gone = (near_duplicates(df, id_col, text_col, shingle, similar).filter(~F.col("kept"))
                .groupBy(col(id_col).alias("__llm_gone")).agg(F.lit(1).alias("one")).select("__llm_gone"))
        gone = keep(materialize(gone, "minhash-gone"))
    return df.join(gone, col(id_col) == F.col("__llm_gone"), "left_anti")
