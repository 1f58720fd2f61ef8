"""Line dedup: deletion-neighbourhood join of lines, keep the earliest.

A line is the words (runs without white space, A-Z in lower case) between two
line breaks.  Every line with a word takes part (``min_words`` can leave shorter
lines alone).  A line goes when an earlier line (by document id, then line number) has the same
words, or, from ``EDIT_WORDS`` words on, the same words but for one inserted,
removed or replaced word.

1. Every line's hash, and the first place of every distinct line (aggregate).
2. A filter without loss: with one edit, two lines still share their first or
   their last half, so only lines that share the hash of a half with another
   distinct line go on.  Ordinary text shares almost none.
3. Those lines emit all their deletion variants: the hash of the line without
   its i-th word, for every i, with i, and the hash of the line itself.  Equal
   variants at one i differ by one replaced word; a variant equal to a whole
   line differs by one inserted word.  The earliest line of each equal group
   is found by an aggregate, so a variant shared by very many lines costs one
   row for each line, never a pair of lines.
4. The words of each line and its earliest partner are compared (the edit
   distance is verified); then every occurrence gets its decision.

Shuffled are hashes and places; of the texts only lines that passed step 2,
found by a filter of their hashes with a fixed largest size.  Joins are plain joins of written tables, which Spark may split
at hot keys.

Edge cases: null or empty texts have no lines and stay as they are; lines of
documents without an id come after all others; rows that repeat an id tie, and
their lines at the same place are decided alike; very long lines are handled
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .tables import drop, materialize, passing
from .textmap import col

#: ``min_words`` with which every line that has a word takes part.
EVERY_LINE = 1
EDIT_WORDS = 8
#: Places of the candidates' filter, as a power of two, at most (16 MB).  With
#: more candidates it lets more lines through; the join behind it is exact.
FILTER_BITS = 27
_NEWLINE = tb.byte_class((0x0A, 0x0A))
_PREFIX, _SUFFIX = tb.U64(0x243F6A8885A308D3), tb.U64(0x13198A2E03707344)


class _Lines:
    """Lines of a chunk: word numbers ``a`` .. ``b`` - 1, row and line number."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.low = tb.lower(data)
        self.start, self.end, row = tb.spans(self.low, off, tb.NOT_SPACE)
        n = len(self.start)
        breaks = np.r_[0, np.cumsum(_NEWLINE[data])]
        number = breaks[self.start] - breaks[off[row]]
        change = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(number) != 0)]) if n else np.zeros(0, np.int64)
        self.a, self.b = change, np.r_[change[1:], n].astype(np.int64) if n else change
        self.row, self.number = row[change], number[change]
        self.hash = tb.SequenceHash(tb.span_hash(self.low, self.start, self.end))

    def words(self, k: int) -> list[bytes]:
        whole = self.low.data
        return [bytes(whole[s:e]) for s, e in zip(self.start[self.a[k]:self.b[k]].tolist(),
                                                  self.end[self.a[k]:self.b[k]].tolist())]


def _id_type(df: DataFrame, id_col: str) -> T.DataType:
    return df.schema[id_col].dataType


def line_table(df: DataFrame, id_col: str, text_col: str, min_words: int = EVERY_LINE) -> DataFrame:
    """(id, line, n_words, h, keys) of every line that takes part."""
    schema = T.StructType([T.StructField("id", _id_type(df, id_col)), T.StructField("line", T.IntegerType()),
                           T.StructField("n_words", T.IntegerType()), T.StructField("h", T.LongType()),
                           T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
                           T.StructField("k3", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, off, _ in tb.chunks(b.column(1)):
                x = _Lines(data, off)
                n = x.b - x.a
                keep = n >= min_words
                a, e, n = x.a[keep], x.b[keep], n[keep]
                if len(a) == 0:
                    continue
                # halves as seen by a line and by one that is a word shorter
                half, less = n // 2, (n - 1) // 2
                rest = n - half
                pre, suf = x.hash.run(a, a + half), x.hash.run(e - rest, e)
                third = np.where(half != less, x.hash.run(a, a + less) ^ _PREFIX,
                                 x.hash.run(e - (n - 1 - less), e) ^ _SUFFIX)
                short = pa.array(n < EDIT_WORDS)
                keys = [pc.if_else(short, pa.scalar(None, pa.int64()), pa.array(tb.signed(tb.mix(k))))
                        for k in (pre ^ _PREFIX, suf ^ _SUFFIX, third)]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(x.row[keep] + lo)), pa.array(x.number[keep].astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.array(tb.signed(x.hash.run(a, e))), *keys], names=schema.names)

    return df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def _place(id_name: str = "id", line: str = "line") -> F.Column:
    """Order of places: by id, rows without one last."""
    return F.struct(F.col(id_name).isNull().alias("no_id"), F.col(id_name).alias("id"), F.col(line).alias("line"))


def _candidates(distinct: DataFrame) -> DataFrame:
    """Distinct lines that share a half with another one."""
    halves = distinct.select("h", F.explode(F.array("k1", "k2", "k3")).alias("k")).filter("k is not null")
    shared = materialize(halves.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "lines-halves")
    found = halves.join(shared, "k").groupBy("h").agg(F.lit(1).alias("one"))
    out = materialize(distinct.join(found.select("h"), "h").select("h", "first"), "lines-candidates")
    drop(shared)
    return out


class _Filter:
    """Bloom filter of line hashes: lines that are not in it are no candidates."""

    def __init__(self, hashes: DataFrame):
        n = hashes.count()
        self.bits = int(np.clip(int(max(16 * n, 1) - 1).bit_length(), 16, FILTER_BITS))
        # two places from the two ends of the hash
        ends = F.array(F.shiftrightunsigned("h", 64 - self.bits), F.col("h").bitwiseAND((1 << self.bits) - 1))
        bit = F.explode(ends).alias("at")
        # one row for each 64 places that have a bit: at most 2^FILTER_BITS / 64
        rows = (hashes.select(bit).groupBy(F.shiftright("at", 6).alias("w"))
                .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("m")).collect())
        words = np.zeros(1 << (self.bits - 6), dtype=np.int64)
        words[[r["w"] for r in rows]] = [r["m"] for r in rows]
        self.words = words.view(np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), dtype=bool)
        for at in ((h >> np.uint64(64 - self.bits)).astype(np.int64), (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)):
            ok &= (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return ok


def _candidate_words(df: DataFrame, text_col: str, candidates: DataFrame) -> DataFrame:
    """(h, first, words) of the candidates; texts are read once more, and only
    lines that pass a filter of the candidates' hashes leave the tasks."""
    shipped = df.sparkSession.sparkContext.broadcast(_Filter(candidates.select("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shipped.value
        for b in batches:
            for _, _, data, off, _ in tb.chunks(b.column(0)):
                x = _Lines(data, off)
                h, k = np.unique(x.hash.run(x.a, x.b), return_index=True)
                ok = wanted.has(h)
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(h[ok])), pa.array(
                    [b" ".join(x.words(i)).decode() for i in k[ok].tolist()], pa.string())], names=["h", "words"])

    found = df.select(col(text_col).cast("string").alias("t")).mapInArrow(run, "h long, words string")
    words = found.groupBy("h").agg(F.min("words").alias("words"))
    return materialize(words.join(candidates, "h"), "lines-words")


def _variants(words: DataFrame) -> DataFrame:
    """(v, pos, h): every line's deletion variants, and the line itself at
    position -1."""
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("pos", T.IntegerType()), words.schema["h"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, off, _ in tb.chunks(b.column(1)):
                x = _Lines(data, off)
                n = x.b - x.a
                i = tb.ragged(x.a, n)
                v = x.hash.without(np.repeat(x.a, n), np.repeat(x.b, n), i)
                row = np.r_[np.repeat(x.row, n), x.row] + lo
                pos = np.r_[i - np.repeat(x.a, n), np.full(len(n), -1)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(tb.signed(np.r_[v, x.hash.run(x.a, x.b)])), pa.array(pos.astype(np.int32)),
                    b.column(0).take(pa.array(row))], names=schema.names)

    return words.select("h", "words").mapInArrow(run, schema)


def _partners(words: DataFrame) -> DataFrame:
    """(h, partner): for every line the earliest line one edit away, if that
    one is earlier."""
    every = _variants(words)
    # only variants that come up again; a line repeats its own when two neighbouring words are equal
    again = materialize(every.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v"), "lines-variants")
    rows = materialize(every.join(again, "v").join(words.select("h", "first"), "h").select("v", "pos", "h", "first"),
                       "lines-shared")
    drop(again)
    per = rows.groupBy("v", "pos").agg(F.min(F.struct("first", "h")).alias("least"), F.count("*").alias("n"))
    # replaced word: equal variants at one place; only groups of several lines
    same = materialize(per.filter("pos >= 0 and n > 1").select("v", "pos", "least"), "lines-same")
    # inserted word: a whole line equals a variant
    both = materialize(per.groupBy("v").agg(
        F.min(F.when(F.col("pos") < 0, F.col("least"))).alias("whole"),
        F.min(F.when(F.col("pos") >= 0, F.col("least"))).alias("shorter"))
        .filter("whole is not null and shorter is not null"), "lines-inserted")
    replaced = rows.join(same, ["v", "pos"]).select("h", "first", F.col("least").alias("partner"))
    inserted = rows.join(both, "v").select(
        "h", "first", F.when(F.col("pos") < 0, F.col("shorter")).otherwise(F.col("whole")).alias("partner"))
    out = (replaced.union(inserted).filter(F.col("partner.first") < F.col("first"))
           .groupBy("h").agg(F.min("partner").alias("partner")))
    out = materialize(out, "lines-partners")
    for t in (rows, same, both):
        drop(t)
    return out


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether one inserted, removed or replaced word at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):] or a == b


def _verified(partners: DataFrame, words: DataFrame) -> DataFrame:
    """(h, partner_first) of the pairs whose words are one edit apart."""
    pairs = (partners.select("h", F.col("partner.h").alias("p"), F.col("partner.first").alias("partner_first"))
             .join(words.select("h", F.col("words").alias("own")), "h")
             .join(words.select(F.col("h").alias("p"), F.col("words").alias("other")), "p")
             .select("h", "partner_first", "own", "other"))
    schema = T.StructType([pairs.schema["h"], pairs.schema["partner_first"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [within_one_edit(x.split(" "), y.split(" ")) for x, y in
                  zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=schema.names).filter(pa.array(ok, pa.bool_()))

    return materialize(pairs.mapInArrow(run, schema), "lines-verified")


def duplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_words: int = EVERY_LINE) -> tuple[DataFrame, DataFrame]:
    """(lines, dropped): every line that takes part (id, line, ...), and of the
    lines that go ``id``, ``line``, the place ``of_id``, ``of_line`` of the
    earliest line within the bound, and ``edits`` (0 or 1)."""
    with passing() as keep:
        lines = keep(materialize(line_table(df, id_col, text_col, min_words), "lines"))
        distinct = materialize(
            lines.groupBy("h").agg(F.min(_place()).alias("first"), F.count("*").alias("n"), F.min("k1").alias("k1"),
                                   F.min("k2").alias("k2"), F.min("k3").alias("k3")), "lines-distinct")
        words = _candidate_words(df, text_col, _candidates(distinct))
        verified = _verified(_partners(words), words)
        # classes in which some line goes: repeated, or with an earlier partner
        classes = keep(materialize(distinct.join(verified, "h", "left").filter("n > 1 or partner_first is not null")
                                   .select("h", "first", "partner_first"), "lines-classes"))
    place = _place()
    hit = lines.join(classes, "h").withColumn("place", place)
    gone = hit.filter((F.col("place") != F.col("first")) | F.col("partner_first").isNotNull())
    near = F.col("partner_first").isNotNull() & (F.col("partner_first") < F.col("first"))
    of = F.when(near, F.col("partner_first")).otherwise(F.col("first"))
    return lines, gone.select("id", "line", of["id"].alias("of_id"), of["line"].alias("of_line"),
                              F.when(near, 1).otherwise(0).alias("edits"))


def _per_document(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy(F.col("id").alias("__llm_id")).agg(
        F.sort_array(F.collect_set(F.struct("line", "of_id", "of_line", "edits"))).alias("__llm_gone"))  # its own lines


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = EVERY_LINE) -> DataFrame:
    """One row for each row of ``df``: id, ``n_lines`` that take part,
    ``n_dropped`` and ``dropped`` (line, of_id, of_line, edits)."""
    lines, gone = duplicate_lines(df, id_col, text_col, min_words)
    count = lines.groupBy(F.col("id").alias("__llm_n_id")).agg(F.countDistinct("line").alias("n_lines"))
    per = _per_document(gone)
    ids = df.select(col(id_col).alias(id_col))
    return (ids.join(count, col(id_col).eqNullSafe(F.col("__llm_n_id")), "left")
            .join(per, col(id_col).eqNullSafe(F.col("__llm_id")), "left")
            .select(id_col, F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.size("__llm_gone"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.coalesce("__llm_gone", F.expr("cast(array() as array<struct<line:int,of_id:%s,of_line:int,edits:int>>)"
                                                    % _id_type(df, id_col).simpleString())).alias("dropped")))


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
               min_words: int = EVERY_LINE) -> DataFrame:
    """``df`` with the duplicate lines cut out of its texts; documents of which
    no line with a word is left go.  ``length_col`` (if given) is set anew."""
    with passing() as keep:
        _, gone = duplicate_lines(df, id_col, text_col, min_words)
        per = keep(materialize(_per_document(gone).select("__llm_id", F.col("__llm_gone.line").alias("__llm_lines")), "lines-gone"))
    joined = df.join(per, col(id_col).eqNullSafe(F.col("__llm_id")), "left")
    left = F.filter(F.split(col(text_col), "\n", -1),
                    lambda x, i: ~F.array_contains(F.col("__llm_lines"), i))
    text = F.when(F.col("__llm_lines").isNull(), col(text_col)).otherwise(F.array_join(left, "\n"))
    out = (joined.withColumn("__llm_new", text)
           .filter(F.col("__llm_lines").isNull() | F.col("__llm_new").rlike(r"[^\x20\x09-\x0D]")))
    length = F.length("__llm_new")
    return out.select(*[F.col("__llm_new").alias(c) if c == text_col else
                        length.cast(df.schema[c].dataType).alias(c) if c == length_col else col(c) for c in df.columns])
