"""Mixing sources to target weights by permuted blocks.

All words of a source form one stream, its documents in a pseudorandom order,
packed into blocks of ``BLOCK`` words.  A source's target is its share of all
words by weight, at most ``MOST`` times its own size; the excess goes to the
others by weight until none is above.  A source's slots walk through its
blocks in epochs: slot k of epoch e takes block ``perm(source, e)(k)``, a
keyed Feistel permutation of the block numbers, so no block comes up again
before all have.  The last slot takes only the words that are still missing,
so the words taken equal the rounded target.  Blocks join slots on (source,
block number).

Output shards: the mix is written as shards of ``SHARD_SLOTS`` slots on
average.  Each slot's shard is drawn, so a shard's source counts are
multinomial with the sources' shares of the mix, given the sources' totals,
and the draw decides which blocks a shard holds: ``mix`` tells the shards of
every document, ``shard_blocks`` lists every shard's blocks and
``shard_counts`` its words by source.  All draws are keyed by (seed, source,
epoch, run): reruns agree, and a lost task repeats the same draws.

Scale: word counts are one map.  Document offsets are a two-level prefix sum
(within sqrt(n) hash buckets of a source, then over the buckets), so a source
with a third of all rows is spread over that many groups.  Slots are generated
from one row for each run of ``RUN`` slots.  Sources are one row each; the
table is broadcast only when it has at most ``BROADCAST_SOURCES`` rows.

Edge cases: null and empty texts have size 0 and are never taken; a null
source is one more source, after the others; a source of size 0 has target 0;
an empty table gives an empty result; repeated rows count one by one in
``mix``, while ``mix_documents`` mixes rows of one id, source and text as one
document and gives each of them its excerpt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textbytes as tb
from .tables import materialize, passing
from .textmap import col, map_text

BLOCK = 128
MOST = 3
#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (1, 2, 3)
RUN = 65_536
SHARD_SLOTS = 1 << 17
BROADCAST_SOURCES = 100_000
SEED = 20

SIZE = T.StructType([T.StructField("__llm_size", T.LongType()), T.StructField("__llm_hash", T.LongType())])


def word_sizes(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Appends the number of words ``[^\\x20\\x09-\\x0D]+`` and a hash of the text."""
    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            n = len(texts)
            size, h = np.zeros(n, np.int64), np.zeros(n, np.uint64)
            for lo, hi, data, off, valid in tb.chunks(texts):
                s, _, row = tb.spans(data, off, tb.NOT_SPACE)
                size[lo:hi] = np.bincount(row, minlength=hi - lo)
                h[lo:hi] = tb.span_hash(data, off[:-1], off[1:]) + valid.astype(np.uint64)
            return [pa.array(size), pa.array(tb.signed(h))]
        return fn

    return map_text(df, text_col, SIZE, make, keep)


def source_targets(sized: DataFrame, source_col: str, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """One row for each source: ``sid``, ``source_size``, ``weight``, ``target``."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = (sized.groupBy(col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
           .withColumn("sid", F.row_number().over(by_name) - 1)
           .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                              (F.col("sid") % len(weights) + 1).cast("int"))))
    per = materialize(per, "mix-sources")
    total = per.agg(F.sum("source_size")).head()[0] or 0
    # a source is full when its share exceeds its limit; each pass shares out what the full ones leave
    scale = -1.0
    while True:
        full = F.col("weight") * F.lit(scale) >= F.lit(float(most)) * F.col("source_size")
        left = per.agg(F.sum(F.when(full, most * F.col("source_size"))).alias("used"),
                       F.sum(F.when(~full, F.col("weight"))).alias("weight")).head()
        if not left["weight"]:
            break
        nxt = (total - (left["used"] or 0)) / left["weight"]
        if nxt <= scale:
            break
        scale = nxt
    scale = max(scale, 0.0)
    return per.withColumn("target", F.least(F.col("weight") * F.lit(scale), F.col("source_size") * F.lit(float(most))))


def locate(sized: DataFrame, sources: DataFrame, source_col: str, id_col: str, n_rows: int) -> DataFrame:
    """Each row's word offset in its source's stream (``off``) and a row key
    (``sid``, ``bucket``, ``pos``)."""
    buckets = max(1, int(np.ceil(np.sqrt(n_rows))))
    at = F.xxhash64(col(id_col).cast("string"), F.col("__llm_hash"), F.lit(SEED))
    rows = (sized.join(sources.select(F.col("source").alias("__llm_src"), "sid", "source_size", "target"),
                       col(source_col).eqNullSafe(F.col("__llm_src")), "inner")
            .withColumn("order", at).withColumn("bucket", F.pmod(at, F.lit(buckets))))
    inside = Window.partitionBy("sid", "bucket").orderBy("order", col(id_col), "__llm_hash")
    rows = (rows.withColumn("pos", F.row_number().over(inside))
            .withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                        - F.col("size")))
    starts = (rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
              .withColumn("start", F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words"))
              .select("sid", "bucket", "start"))
    return rows.join(starts, ["sid", "bucket"]).withColumn("off", F.col("start") + F.col("before"))


class Permutation:
    """Keyed permutation of 0 .. n - 1: a Feistel network on the next even
    number of bits, walked until the number is in range."""

    def __init__(self, n: int, *key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        state = np.zeros(1, dtype=np.uint64)
        for k in key:
            state = tb.mix(state * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k % (1 << 64)))
        self.keys = [tb.mix(state + np.uint64(i + 1))[0] for i in range(4)]

    def _rounds(self, x: np.ndarray, keys, inverse: bool) -> np.ndarray:
        h = np.uint64(self.half)
        left, right = x >> h, x & self.mask
        for k in keys:
            if inverse:
                left, right = right ^ (tb.mix(left + k) & self.mask), left
            else:
                left, right = right, left ^ (tb.mix(right + k) & self.mask)
        return left << h | right

    def _walk(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        keys = self.keys[::-1] if inverse else self.keys
        x = self._rounds(np.asarray(x, dtype=np.uint64), keys, inverse)
        out = np.flatnonzero(x >= self.n)
        while len(out):
            x[out] = self._rounds(x[out], keys, inverse)
            out = out[x[out] >= self.n]
        return x.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


#: Joins with slots carry a merge hint: Spark sees that they come from a few
#: source rows and would broadcast what these grow into.
SLOTS = "sid int, epoch int, slot long, block long, words long, shard long"


def slots(sources: DataFrame, block: int = BLOCK, seed: int = SEED, run: int = RUN,
          shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """All slots: block ``block`` of source ``sid`` gives its first ``words``
    words to output shard ``shard``."""
    want = F.round("target").cast("long")
    per = (sources.filter("source_size > 0")
           .select("sid", "source_size", F.expr(f"(source_size + {block - 1}) div {block}").alias("blocks"), want.alias("want"))
           .withColumn("epoch", F.explode(F.expr("sequence(0, cast(want div source_size as int))")))
           .withColumn("need", F.least("source_size", F.col("want") - F.col("epoch") * F.col("source_size")))
           .filter("need > 0")
           .withColumn("n", F.least("blocks", F.expr(f"(need + {block - 1}) div {block} + 1"))))
    total = per.agg(F.sum("n")).head()[0] or 0
    shards = max(1, -(-total // shard_slots))
    runs = (per.withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {run}L)")))
            .select("sid", "source_size", "blocks", "epoch", "need", "from",
                    F.least("n", F.col("from") + run).alias("to"))
            .repartition("sid", "epoch", "from"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n_blocks, key = r["blocks"], (seed, r["sid"], r["epoch"])
                perm = Permutation(n_blocks, *key)
                k = np.arange(r["from"], r["to"], dtype=np.int64)
                at = perm(k)
                last = r["source_size"] - (n_blocks - 1) * block  # words of the last block
                before = k * block - np.where(k > perm.inverse(np.array([n_blocks - 1]))[0], block - last, 0)
                words = np.clip(r["need"] - before, 0, np.where(at == n_blocks - 1, last, block))
                rng = np.random.Generator(np.random.Philox(key=int(tb.mix(
                    np.array([seed * 1_000_003 + r["sid"]], np.uint64) * tb.U64(31) + tb.U64(r["epoch"]))[0] >> tb.U64(1))
                    + r["from"]))
                if shards <= len(k):  # the run's counts by shard, then which of its slots they are
                    counts = rng.multinomial(len(k), np.full(shards, 1.0 / shards))
                    shard = rng.permutation(np.repeat(np.arange(shards), counts))
                else:  # the same draw, slot by slot
                    shard = rng.integers(shards, size=len(k))
                keep = words > 0
                size = int(keep.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, r["sid"], np.int32)), pa.array(np.full(size, r["epoch"], np.int32)),
                     pa.array(k[keep]), pa.array(at[keep]), pa.array(words[keep]), pa.array(shard[keep])],
                    names=["sid", "epoch", "slot", "block", "words", "shard"])

    return runs.mapInArrow(make, SLOTS)


def _placed(sized: DataFrame, source_col: str, id_col: str, weights, most: float) -> tuple[DataFrame, DataFrame]:
    """(located rows, sources) of materialized ``sized``."""
    sources = materialize(source_targets(sized, source_col, weights, most), "mix-targets")
    few = sources.count() <= BROADCAST_SOURCES  # the checked size of the broadcast side
    return locate(sized, F.broadcast(sources) if few else sources, source_col, id_col, sized.count()), sources


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """The part of every row in every block: ``at`` (first word in the block),
    ``first`` (first word in the document) and ``n`` words."""
    return (rows.withColumn("block", F.explode_outer(F.expr(
                f"case when size > 0 then sequence(off div {block}, (off + size - 1) div {block}) end")))
            .withColumn("first", F.greatest(F.lit(0), F.col("block") * block - F.col("off")))
            .withColumn("at", F.col("off") + F.col("first") - F.col("block") * block)
            .withColumn("n", F.least(F.col("size") - F.col("first"), block - F.col("at"))))


def shard_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights=WEIGHTS, most: float = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The shards' contents: (shard, sid, epoch, slot, block, id, first, n) for
    the ``n`` words from word ``first`` of document ``id`` in each block drawn."""
    sized = materialize(word_sizes(df, text_col, [id_col, source_col])
                        .withColumnRenamed("__llm_size", "size"), "mix-sizes")
    rows, sources = _placed(sized, source_col, id_col, weights, most)
    pieces = _pieces(rows.select("sid", col(id_col).alias("id"), "size", "off"), block)
    n = F.least(F.col("at") + F.col("n"), F.col("words")) - F.col("at")
    return (pieces.join(slots(sources, block, shard_slots=shard_slots).hint("merge"), ["sid", "block"])
            .withColumn("n", n).filter("n > 0").select("shard", "sid", "epoch", "slot", "block", "id", "first", "n"))


def shard_counts(df: DataFrame, text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = MOST,
                 block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, source, slots, words): what each shard draws of each source."""
    sized = word_sizes(df, text_col, [source_col]).withColumnRenamed("__llm_size", "size")
    sources = materialize(source_targets(sized, source_col, weights, most), "mix-targets")
    drawn = slots(sources, block, shard_slots=shard_slots).groupBy("shard", "sid").agg(
        F.count("*").alias("slots"), F.sum("words").alias("words"))
    return drawn.join(sources.select("sid", "source"), "sid").select("shard", "source", "slots", "words")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, most: float = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Per row of ``df``: id, ``size``, ``source_size``, ``target``, ``taken``
    (words of the row in the mix, repeats counted), ``n_shards`` and
    ``first_shard`` (the output shards that hold words of it; 0 and null where
    none does)."""
    sized = materialize(word_sizes(df, text_col, [id_col, source_col])
                        .withColumnRenamed("__llm_size", "size"), "mix-sizes")
    rows, sources = _placed(sized, source_col, id_col, weights, most)
    pieces = _pieces(rows.select("sid", "bucket", "pos", col(id_col).alias("id"), "size", "source_size", "target", "off"), block)
    # a block without a slot has no words (least() would pass over the null)
    taken = F.when(F.col("words").isNull(), 0).otherwise(
        F.greatest(F.lit(0), F.least(F.col("at") + F.col("n"), F.col("words")) - F.col("at")))
    drawn = slots(sources, block, shard_slots=shard_slots).select("sid", "block", "words", "shard")
    holds = F.when(taken > 0, F.col("shard"))
    return (pieces.join(drawn.hint("merge"), ["sid", "block"], "left")
            .groupBy("sid", "bucket", "pos")
            .agg(F.first("id").alias(id_col), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
                 F.first("target").alias("target"), F.coalesce(F.sum(taken), F.lit(0)).cast("long").alias("taken"),
                 # a document's own blocks
                 F.size(F.collect_set(holds)).cast("long").alias("n_shards"), F.min(holds).alias("first_shard"))
            .drop("sid", "bucket", "pos"))


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  length_col: str | None = None, weights=WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """The mix as documents: one row for each document and epoch in which
    words of it are taken, with the columns of ``df``.  The text holds the
    words taken in that epoch; parts that do not follow each other are on lines
    of their own.  ``length_col`` (if given) becomes the new text's length."""
    keys = ["__llm_id", "__llm_source", "__llm_key"]
    with passing() as keep:
        parts = keep(materialize(_document_parts(df, keys, id_col, text_col, source_col, weights, most, block), "mix-parts"))
    # Spark's own hash of the text: a task then has one Python step, the excerpts
    same = (col(id_col).eqNullSafe(F.col("__llm_id")) & col(source_col).eqNullSafe(F.col("__llm_source"))
            & (F.col("__llm_own_key") == F.col("__llm_key")))
    joined = df.withColumn("__llm_own_key", _text_key(text_col)).join(parts, same).select(*[col(c) for c in df.columns], "__llm_parts", "__llm_size")
    out = _excerpts(joined, text_col)
    if length_col:
        out = out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType))
    return out.select(*[col(c) for c in df.columns])


def _text_key(text_col: str) -> F.Column:
    return F.xxhash64(col(text_col).cast("string"))


def _document_parts(df: DataFrame, keys: list[str], id_col: str, text_col: str, source_col: str, weights, most: float,
                    block: int) -> DataFrame:
    """(keys, epoch, __llm_size, __llm_parts): the words taken of each document
    in each epoch that takes some."""
    slim = df.select(col(id_col).alias("__llm_id"), col(source_col).alias("__llm_source"),
                     col(text_col).alias("__llm_t"), _text_key(text_col).alias("__llm_key"))
    sized = materialize(word_sizes(slim, "__llm_t", keys).withColumnRenamed("__llm_size", "size")
                        .filter("size > 0").dropDuplicates(["__llm_id", "__llm_source", "__llm_hash"]), "mix-sizes")
    rows, sources = _placed(sized, "__llm_source", "__llm_id", weights, most)
    pieces = _pieces(rows.select(*keys, "sid", "off", "size"), block)
    n = F.least(F.col("at") + F.col("n"), F.col("words")) - F.col("at")
    return (pieces.join(slots(sources, block).select("sid", "block", "epoch", "words").hint("merge"), ["sid", "block"])
            .withColumn("n", n).filter("n > 0")
            .groupBy(*keys, "size", "epoch")
            .agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("__llm_parts"))  # a document's own blocks
            .withColumnRenamed("size", "__llm_size"))


def _excerpts(joined: DataFrame, text_col: str) -> DataFrame:
    keep = [c for c in joined.columns if c not in (text_col, "__llm_parts", "__llm_size")]
    schema = T.StructType([joined.schema[c] for c in keep] + [T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(len(keep) + 1)
            size = np.asarray(b.column(len(keep) + 2))
            p_off = np.asarray(lists.offsets, dtype=np.int64)
            first = np.asarray(lists.values.field(0), dtype=np.int64)
            count = np.asarray(lists.values.field(1), dtype=np.int64)
            for lo, hi, data, off, _ in tb.chunks(b.column(len(keep))):
                texts = []
                s, e, row = tb.spans(data, off, tb.NOT_SPACE)
                base = np.searchsorted(row, np.arange(hi - lo))
                whole = data.tobytes()
                for r in range(hi - lo):
                    a, z = p_off[lo + r], p_off[lo + r + 1]
                    f, c = first[a:z], count[a:z]
                    if c.sum() == size[lo + r]:
                        texts.append(whole[off[r]:off[r + 1]].decode())
                        continue
                    cut = np.flatnonzero(np.r_[True, f[1:] != (f + c)[:-1]])
                    stop = np.r_[(f + c)[cut[1:] - 1], f[-1] + c[-1]]
                    texts.append("\n".join(whole[s[base[r] + x]:e[base[r] + y - 1]].decode()
                                           for x, y in zip(f[cut], stop)))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns[:len(keep)]],
                                                  pa.array(texts, pa.string())], names=schema.names)

    return joined.select(*[col(c) for c in keep], col(text_col), "__llm_parts", "__llm_size").mapInArrow(run, schema)
