"""Spelling variants among words, found through variable-length grams.

Words are counted over all texts.  A word is read with an end mark behind it
and decomposed from its start into grams of two symbols or more: a gram grows
by a symbol, up to ``MAX_GRAM``, while it is frequent, i.e. stands at more than
one in ``FREQUENT`` places of all words.  So the dictionary is the trie of
grams pruned below its first infrequent node; its inner nodes are at most
``FREQUENT`` grams of each length, and that is what the tasks get.

A gram depends on its own symbols and on where it starts.  One edit therefore
affects one gram of a word, the one that holds its place (a word's bound of
affected grams is one, by grams that do not overlap), and both words agree in
the grams before it, so the affected gram starts at the same place in both;
behind it they agree symbol by symbol.  A near word thus stands in the lists
of all grams of the word but one.  These lists are merged at once: the index
holds, under the hash of (length, start and length of a gram, all symbols but
the gram's), the words that have them all.  Of two near words' affected grams
one is the longer, so it is enough that every word looks up its own grams and
is listed under its grams' lengths and greater ones (up to ``MAX_GRAM`` + 1 for
words longer by a symbol).  What meets under a key is verified by the edit
distance on whole words.

Tables as long as the words are joined by sort and merge, whatever their size:
Spark takes rows made in Python, many for a word, for as many as the words, and
a compressed file's size for the size in memory, so it would broadcast tables
that no driver holds.

No list is cut.  Words that meet differ in two to four neighbouring symbols;
their pairs stay where they met, and only verified ones leave the task.  A form
has at least twice the occurrences of its word, so the chains of forms end and
pointer doubling follows them in a few rounds.

Edge cases: null texts have no words, a null id counts as empty text; words of
any length are handled (rows in proportion to the word; only words of up to
``CARRIED`` symbols travel with their rows, others are verified by a join);
equal occurrence numbers are decided by code-point order; repeated rows count
as often as they stand; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .tables import drop, materialize
from .textmap import col

RUN = "[a-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
#: A gram at more than one in so many places is frequent and grows by a symbol.
FREQUENT = 128
MAX_GRAM = 3
#: Words of up to so many symbols stand in the rows of the index.
CARRIED = 64
#: A form has at least this many times the word's occurrences.
RATIO = 2
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# -- words -------------------------------------------------------------------

def misspelled(doc_id: Column, run: Column, every: int = 97) -> Column:
    """A run with one code point deleted in one of ``every`` cases, chosen by
    the checksum of its document's id and itself."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``MIN_LENGTH`` code points that
    occur at least ``MIN_COUNT`` times; counted inside the tasks first."""
    low = F.translate(col(text_col).cast("string"), _UP, _LOW)
    runs = docs.select(col(id_col).alias("d"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("r"))
    return (runs.select(misspelled(F.col("d"), F.col("r")).alias("word")).filter(F.length("word") >= MIN_LENGTH)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT))


# -- grams -------------------------------------------------------------------

class Flat:
    """Words of a batch as one array of symbols (code points below 256), each
    word with its end mark."""

    def __init__(self, words: pa.Array):
        raw = [w.encode("latin-1") for w in words.to_pylist()]
        self.size = np.array([len(r) + 1 for r in raw], np.int64)
        self.symbols = np.frombuffer(b"$".join(raw) + b"$" if raw else b"", np.uint8)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size

    def grams(self, at: np.ndarray, length: int) -> np.ndarray:
        """The grams at the places ``at`` as integers."""
        out = np.zeros(len(at), np.int64)
        for i in range(length):
            out = (out << 8) | self.symbols[at + i]
        return out

    def decompose(self, frequent: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, place, length) of the words' grams, from their starts; the
        last one may be shorter than two symbols.  All words take one step
        after another, so the steps are as many as the longest has grams."""
        word, at = np.arange(len(self.size)), self.start.copy()
        out = []
        while len(word):
            left = self.end[word] - at
            length = np.minimum(left, 2)
            for q in range(2, MAX_GRAM):
                more = np.flatnonzero((length == q) & (left > q))
                more = more[np.isin(self.grams(at[more], q), frequent.get(q, ()))]
                length[more] += 1
            out.append((word, at, length))
            go = at + length < self.end[word]
            word, at = word[go], (at + length)[go]
        return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros((3, 0), np.int64))

    def keys(self, word: np.ndarray, at: np.ndarray, length: np.ndarray, size: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Hashes of (size, place, gap) and all symbols but the ``length`` at
        ``at``; ``size`` and ``gap`` are those of the words that are sought."""
        before = tb.span_hash(self.symbols, self.start[word], at)
        behind = tb.span_hash(self.symbols, at + length, self.end[word])
        place = (at - self.start[word]).astype(np.uint64)
        form = tb.mix((size.astype(np.uint64) << np.uint64(32)) ^ (place << np.uint64(3)) ^ gap.astype(np.uint64))
        return tb.signed(tb.mix(before ^ tb.mix(behind ^ form)))


def frequent_grams(words: DataFrame) -> dict[int, np.ndarray]:
    """The frequent grams by length: the inner nodes of the pruned trie, at
    most ``FREQUENT`` of a length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = Flat(b.column(0))
            for q in range(2, MAX_GRAM):
                last = np.repeat(flat.end, flat.size)
                at = np.flatnonzero(np.arange(len(last)) + q <= last)
                gram, n = np.unique(flat.grams(at, q), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram), q, np.int32)), pa.array(gram), pa.array(n.astype(np.int64))], names=["q", "gram", "n"])

    counts = words.select("word").mapInArrow(run, "q int, gram long, n long").groupBy("q", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "gram-counts", files=1)  # at most 91^2 rows of two symbols
    places = counts.groupBy("q").agg(F.sum("n").alias("places"))
    found = counts.join(places, "q").filter(F.col("n") * FREQUENT > F.col("places")).select("q", "gram").collect()
    drop(counts)
    return {q: np.array([r["gram"] for r in found if r["q"] == q], np.int64) for q in {r["q"] for r in found}}


_ROW = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def _rows(words: DataFrame, frequent: dict[int, np.ndarray], wanted: bool) -> DataFrame:
    """(key, id, text) for each gram of each word: the keys under which a word
    is listed, or those that it looks up (``wanted``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = Flat(b.column(1))
            word, at, length = flat.decompose(frequent)
            size, left = flat.size[word], flat.end[word] - at
            texts = pa.array([w if len(w) <= CARRIED else None for w in b.column(1).to_pylist()], pa.string())
            for by in ((-1, 0, 1) if wanted else range(MAX_GRAM)):
                if wanted:   # words of as many symbols, or of one less or more, all of it in the gram
                    on, own, gap = np.flatnonzero(length + by > 0), length, length + by
                else:        # as long as the gram, or longer
                    own = gap = length + by
                    on = np.flatnonzero((gap <= MAX_GRAM + 1) & (gap <= left))
                sought = size + by if wanted else size
                key = flat.keys(word[on], at[on], own[on], sought[on], gap[on])
                w = pa.array(word[on])
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(w), texts.take(w)], names=_ROW.names)

    return words.select("id", "word").mapInArrow(run, _ROW)


def _merged(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is never broadcast."""
    return rows.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) ids of words one edit apart, each pair once, a < b; ``words``
    has id and word and is a table (it is read several times)."""
    frequent = frequent_grams(words)
    listed = _rows(words, frequent, wanted=False).toDF("key", "b", "y")
    seeking = _rows(words, frequent, wanted=True).toDF("key", "a", "x")
    met = materialize(
        seeking.join(_merged(listed), "key").filter("a <> b")
        .filter(F.col("x").isNull() | F.col("y").isNull() | (F.levenshtein("x", "y", 1) == 1))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("x").isNull() | F.col("y").isNull()).alias("open"))
        .distinct(), "near-words")
    text = words.select("id", "word")
    checked = (met.filter("open").join(_merged(text.toDF("a", "x")), "a").join(_merged(text.toDF("b", "y")), "b")
               .filter(F.levenshtein("x", "y", 1) == 1).select("a", "b"))
    return met.filter("not open").select("a", "b").union(checked)


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root id) where ``forms`` has (id, form id): each round doubles the
    steps followed."""
    at = materialize(forms.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        nxt = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = materialize(at.join(_merged(nxt), "root", "left").select(
            "id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop(at)
        at = moved.select("id", "root")
        at._llm_path = moved._llm_path
        if moved.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``form`` (its near word of most occurrences, if they
    are at least ``RATIO`` times its own), ``root`` (the end of the chain of
    forms), ``n``, ``n_near`` (words one edit away) and ``form_n``."""
    return variants(word_counts(docs, id_col, text_col))


def variants(counts: DataFrame) -> DataFrame:
    """The same for a table of distinct words (word, n)."""
    words = materialize(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    pairs = materialize(near_pairs(words), "near-pairs")
    other = words.select(F.col("id").alias("b"), F.col("word").alias("w"), F.col("n").alias("m"))
    near = (pairs.union(pairs.select("b", "a")).join(_merged(other), "b").groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "w", "b")).alias("best"))
        .select(F.col("a").alias("id"), "n_near", (-F.col("best.m")).alias("m"), "best.w", F.col("best.b").alias("form_id")))
    known = materialize(words.join(_merged(near), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(F.col("m") >= RATIO * F.col("n"), F.col(c)).alias(to) for c, to in (("w", "form"), ("m", "form_n"), ("form_id", "form_id"))]),
        "word-forms")
    drop(pairs)
    roots = _roots(known.filter("form_id IS NOT NULL"))
    ends = roots.join(_merged(words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))), "root").select("id", "root_word")
    return known.join(_merged(ends), "id", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
