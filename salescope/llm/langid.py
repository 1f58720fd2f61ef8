"""Language identification with bit-sliced Bloom filters of n-grams.

For every language the frequent byte n-grams (``GRAMS``) of a sample of its
texts go into a Bloom filter.  The filters of all languages have the same size
and hash functions and are stored bit-sliced: one 64-bit word for each place,
with one bit for each language.  The words at an n-gram's places, combined by
AND, give at once the bitmask of all languages that contain it.  Adding up the
bits over a text gives each language's hits; the false positives expected from
the filter's fill are taken out, ``(hits - n * f) / (1 - f)``, and the language
with the most is the answer.

Texts are seen as lower-case letters (ASCII A-Z; other bytes as they are), with
every run of other ASCII bytes as a gap; n-grams may begin or end with one gap.

What is collected: the languages with their row counts, and at most
``1 / SHARE`` n-grams for each length and language (an n-gram must make up that
share of its language's).  The sample is ``TRAIN_ROWS`` texts a language on
average.  Prediction is one Arrow map over the whole table.

Edge cases: a text that is null or has no letter gets ``und`` and score 0; a
text with letters but without a known n-gram gets the language with the most
rows, at score 0; of equal languages the first by name wins; without any
labelled row every text gets ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .sampling import draw, threshold
from .textmap import col, map_text

#: Texts of each language to learn from, on average (all, if there are fewer).
TRAIN_ROWS = 2_000
GRAMS = (2, 3, 4)
#: Least share of an n-gram among those of its length in its language.
SHARE = 2e-4
HASHES = 3
BITS_PER_GRAM = 12
UNKNOWN = "und"

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("n_grams", T.LongType())])

_SEEN = np.full(256, 0x20, dtype=np.uint8)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[97:123] = np.arange(97, 123)
_SEEN[128:] = np.arange(128, 256)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of all n-grams of a chunk.  Every row has a gap on either
    side; an n-gram of a single gap between letters is left out, and so is one
    with two gaps in a row."""
    rows = len(off) - 1
    size = np.diff(off)
    seen = np.full(len(data) + rows + 1, 0x20, dtype=np.uint8)
    seen[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), size)] = _SEEN[data]
    # runs of gaps shrink to one, so "a  b" and "a b" have the same n-grams
    gap = seen == 0x20
    ends = np.cumsum(size) + np.arange(1, rows + 1)   # the gap behind each row
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[ends] = True
    keep[0] = True
    new_row = np.repeat(np.arange(rows + 1), np.diff(np.r_[0, ends, len(seen)]))[keep] if rows else np.zeros(0, int)
    seen = seen[keep].astype(np.uint64)
    gap = seen == 0x20
    codes, where = [], []
    for n in GRAMS:
        m = len(seen) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, dtype=np.uint64)
        inner = np.zeros(m, dtype=bool)  # a gap inside: the n-gram spans two words
        for k in range(n):
            code = code << np.uint64(8) | seen[k:k + m]
            if 0 < k < n - 1:
                inner |= gap[k:k + m]
        ok = np.flatnonzero(~inner & ~(gap[:m] & gap[n - 1:n - 1 + m]) if n == 2 else ~inner)
        codes.append(code[ok] | np.uint64(n << 32))
        where.append(new_row[ok + gap[ok]])  # of its first letter
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(where)


class BitSlicedFilters:
    """The Bloom filters of all languages; ``masks`` looks n-grams up."""

    def __init__(self, langs: list[str], grams_of: list[np.ndarray]):
        self.langs = langs
        most = max([len(g) for g in grams_of] or [1])
        self.bits = max(10, int(np.ceil(np.log2(max(1, most) * BITS_PER_GRAM))))
        self.planes = -(-len(langs) // 64) or 1
        self.words = np.zeros((self.planes, 1 << self.bits), dtype=np.uint64)
        for i, g in enumerate(grams_of):
            for at in self.places(g):
                self.words[i // 64, at] |= np.uint64(1 << (i % 64))
        fill = np.array([np.count_nonzero(self.words[i // 64] >> np.uint64(i % 64) & np.uint64(1))
                         for i in range(len(langs))]) / (1 << self.bits)
        self.false_rate = fill ** HASHES

    def places(self, g: np.ndarray) -> list[np.ndarray]:
        h = tb.mix(g)
        return [((h >> np.uint64(21 * k)) & np.uint64((1 << self.bits) - 1)).astype(np.int64) for k in range(HASHES)]

    def hits(self, g: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """n-grams of each row that each language contains."""
        out = np.zeros((rows, len(self.langs)))
        at = self.places(g)
        for p in range(self.planes):
            mask = self.words[p][at[0]]
            for a in at[1:]:
                mask &= self.words[p][a]
            for i in range(64 * p, min(64 * p + 64, len(self.langs))):
                out[:, i] = np.bincount(row[(mask >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=rows)
        return out


class LanguageModel:
    def __init__(self, langs: list[str], rows: list[int], grams_of: list[np.ndarray]):
        self.langs, self.filters = langs, BitSlicedFilters(langs, grams_of)
        self.common = int(np.argmax(rows)) if langs else -1

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, n-grams) of every row."""
        rows = len(off) - 1
        g, row = grams(data, off)
        n = np.bincount(row, minlength=rows).astype(np.int64)
        f = self.filters.false_rate
        real = np.maximum(0.0, (self.filters.hits(g, row, rows) - n[:, None] * f) / (1.0 - f))
        best, total = real.argmax(axis=1), real.sum(axis=1)
        score = np.where(total > 0, real[np.arange(rows), best] / np.where(total > 0, total, 1.0), 0.0)
        return np.where(total > 0, best, self.common), score, n


def fit(df: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        most: int = TRAIN_ROWS) -> LanguageModel:
    """Learn from the texts with a language whose id fulfils ``allowed``."""
    known = (df.select(col(id_col).alias(id_col), col(text_col).cast("string").alias("text"),
                       col(lang_col).cast("string").alias("lang"))
             .filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    # one row for each language
    counts = sorted((r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())
    langs = [c[0] for c in counts]
    if not langs:
        return LanguageModel([], [], [])
    cuts = F.create_map(*[x for name, n in counts for x in (F.lit(name), F.lit(threshold(n, most)))])
    train = known.filter(draw(id_col) < cuts[F.col("lang")]).select("text", "lang")
    number = {name: i for i, name in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array([number[x] for x in b.column(1).to_pylist()], dtype=np.int64)
            for lo, hi, data, off, _ in tb.chunks(b.column(0)):
                g, row = grams(data, off)
                which = lang[lo:hi][row]
                for i in np.unique(which):
                    code, n = np.unique(g[which == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), i, np.int32)),
                                                      pa.array(code.view(np.int64)), pa.array(n)], names=["l", "g", "n"])

    per = train.mapInArrow(run, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    sums = {(r["l"], r["k"]): r["n"] for r in per.groupBy("l", F.shiftright("g", 32).alias("k"))
            .agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[x for (i, k), n in sums.items()
                           for x in (F.lit(f"{i}:{k}"), F.lit(float(n * SHARE)))]) if sums else None
    grams_of: list[list[int]] = [[] for _ in langs]
    if least is not None:
        # at most 1 / SHARE n-grams for each length and language
        key = F.concat_ws(":", F.col("l").cast("string"), F.shiftright("g", 32).cast("string"))
        for r in per.filter(F.col("n") >= least[key]).select("l", "g").collect():
            grams_of[r["l"]].append(r["g"])
    return LanguageModel(langs, [c[1] for c in counts], [np.sort(np.array(g, dtype=np.int64)).view(np.uint64) for g in grams_of])


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends ``lang_pred``, ``score`` and ``n_grams``."""
    names = np.array([*model.langs, UNKNOWN], dtype=object)

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            n = len(texts)
            lang, score, count = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
            if model.langs:
                for lo, hi, data, off, _ in tb.chunks(texts):
                    lang[lo:hi], score[lo:hi], count[lo:hi] = model.predict(data, off)
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
            lang[~letters], score[~letters] = -1, 0.0
            return [pa.array(names[lang], pa.string()), pa.array(score), pa.array(count)]
        return fn

    return map_text(df, text_col, FIELDS, make, keep)
