"""License scans: exact set-similarity join of text blocks with templates.

A template is the set of words of a license notice.  A block matches when it
holds at least ``threshold`` of the template's distinct words.  The join is
exact and uses the filters of a prefix join:

* the words of all templates are put in one global order, rarest first, by
  their number of occurrences in the whole table (one aggregate, as many rows
  as the templates have words);
* prefix filter: a block that lacks all of a template's first
  ``|T| - need + 1`` words in that order cannot reach ``need`` common words;
* length filter: a block with fewer than ``need`` distinct words is left out;
* positional filter: from the first common word on, block and template must
  both have ``need`` words left;
* what remains is verified by counting the common words.

Blocks are all windows of ``BLOCK_WORDS`` words of the text's whole word
stream, one from every word on, so a notice may be wrapped over lines at any
place.  Every stretch of neighbouring windows that match gives one match, its
best window.  Windows are not made one by one: around the prefix words lie the
zones that the windows in question cover; a zone passes the length filter if
it has ``need`` words, and the positional filter if from its first common word
in the global order on it and the template both have ``need`` words left; in
the zones that remain each place of a template's word adds one to the windows
that hold it and no earlier place of the same word.  With
``across_lines=False`` the blocks are the lines of a text instead, longer ones
cut into windows of ``BLOCK_WORDS`` words that overlap by half.

Besides, every place where a base phrase's words stand consecutively is found
by comparing word hashes (64 bits).  Templates and phrases are the only data
shipped to tasks; their size does not depend on the corpus.

Edge cases: a null or empty text has no words, no labels and score 0; repeated
rows are scanned one by one; an empty table gives an empty result; a row whose
id is null is scanned like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textbytes as tb
from .textmap import col, map_text

#: Base phrases and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Notices whose word sets the join looks for.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the mozilla public license version 2 0", "mpl-2"),
]
THRESHOLD = 0.8
BLOCK_WORDS = 64

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("base", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))),
    T.StructField("matches", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()),
        T.StructField("word", T.LongType()), T.StructField("containment", T.DoubleType())]))),
    T.StructField("score", T.DoubleType()),
])
_NEWLINE = tb.byte_class((0x0A, 0x0A))


def _split(text: str) -> list[str]:
    return text.lower().split()


def word_counts(df: DataFrame, text_col: str, words: list[str]) -> dict[str, int]:
    """Occurrences of each given word in the whole column.  One row per given
    word comes back to the driver."""
    hashes = tb.hash_words(words)
    order = np.argsort(hashes)
    ranked = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), dtype=np.int64)
        for b in batches:
            for _, _, data, off, _ in tb.chunks(b.column(0)):
                data = tb.lower(data)
                s, e, _ = tb.spans(data, off, tb.WORD)
                h = tb.span_hash(data, s, e)
                at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
                total += np.bincount(order[at[ranked[at] == h]], minlength=len(words))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["w", "n"])

    rows = (df.select(col(text_col).cast("string").alias("t")).mapInArrow(run, "w int, n long")
            .groupBy("w").sum("n").collect())
    found = {words[r[0]]: int(r[1]) for r in rows}
    return {w: found.get(w, 0) for w in words}


class _Join:
    """Templates in the global order, ready to be probed with blocks."""

    def __init__(self, templates, phrases, freq, threshold):
        order = sorted(freq, key=lambda w: (freq[w], w))
        rank = {w: i for i, w in enumerate(order)}
        self.vocab_n = len(order)
        hashes = tb.hash_words(order)
        by = np.argsort(hashes)
        self.sorted_hash, self.sorted_rank = hashes[by], by.astype(np.int32)
        self.labels = [label for _, label in templates]
        self.sets = np.zeros((len(templates), len(order)), dtype=np.int32)
        self.need = np.zeros(len(templates), dtype=np.int64)
        self.prefix = np.zeros((len(templates), len(order)), dtype=bool)
        for i, (text, _) in enumerate(templates):
            own = sorted({rank[w] for w in _split(text)})
            self.sets[i, own] = 1
            self.need[i] = max(1, int(np.ceil(threshold * len(own) - 1e-9)))
            self.prefix[i, own[:len(own) - self.need[i] + 1]] = True
        self.size = self.sets.sum(axis=1)
        self.any_prefix = self.prefix.any(axis=0)
        self.phrases = [([int(h) for h in tb.hash_words(_split(p))], label) for p, label in phrases]

    def ranks(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted_hash, h), self.vocab_n - 1)
        return np.where(self.sorted_hash[at] == h, self.sorted_rank[at], -1)

    def base(self, h, row):
        """(place among the words, label) of every base phrase."""
        out = []
        for hs, label in self.phrases:
            k = len(hs)
            if len(h) < k:
                continue
            ok = h[:len(h) - k + 1] == tb.U64(hs[0])
            for j in range(1, k):
                ok &= h[j:len(h) - k + 1 + j] == tb.U64(hs[j])
            ok &= row[:len(row) - k + 1] == row[k - 1:]
            out += [(int(i), label) for i in np.flatnonzero(ok)]
        return out

    def blocks(self, h, line):
        """(first word, template, containment) of every matching block."""
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        length = np.diff(np.r_[first, len(line)])
        half = BLOCK_WORDS // 2
        # windows of a line: one, or as many as overlap by half
        wins = np.where(length <= BLOCK_WORDS, 1, -(-(length - BLOCK_WORDS) // half) + 1)
        win0 = np.cumsum(wins) - wins
        pos = np.arange(len(line)) - np.repeat(first, length)
        n_win, base = np.repeat(wins, length), np.repeat(win0, length)
        r = self.ranks(h)
        known = np.flatnonzero(r >= 0)
        if len(known) == 0:
            return []
        pos, n_win, base, r = pos[known], n_win[known], base[known], r[known]
        last = np.minimum(pos // half, n_win - 1)
        before = (last > 0) & (pos < (last - 1) * half + BLOCK_WORDS)
        block = np.r_[base + last, (base + last - 1)[before]]
        r = np.r_[r, r[before]]
        # prefix filter: blocks with a prefix word of some template
        hit = np.unique(block[self.any_prefix[r]])
        if len(hit) == 0:
            return []
        inside = np.searchsorted(hit, block)
        ok = (inside < len(hit)) & (hit[np.minimum(inside, len(hit) - 1)] == block)
        m = np.zeros((len(hit), self.vocab_n), dtype=np.int32)
        m[inside[ok], r[ok]] = 1
        start, size = self._extent(hit, win0, wins, first, length, half)
        # words of the block from each place of the global order on
        left = m[:, ::-1].cumsum(axis=1)[:, ::-1]
        out = []
        for t in range(len(self.need)):
            common = m.astype(bool) & self.prefix[t]
            cand = common.any(axis=1) & (size >= self.need[t])
            at = common.argmax(axis=1)
            t_left = self.sets[t][::-1].cumsum()[::-1]
            cand &= (left[np.arange(len(hit)), at] >= self.need[t]) & (t_left[at] >= self.need[t])
            c = np.flatnonzero(cand)
            share = m[c] @ self.sets[t]
            for b, n in zip(c[share >= self.need[t]], share[share >= self.need[t]]):
                out.append((int(start[b]), t, float(n) / float(self.size[t])))
        return out

    def windows(self, h, row):
        """(first word, template, containment) of the best window of every
        stretch of matching windows, across line breaks."""
        r = self.ranks(h)
        known = np.flatnonzero(r >= 0)
        if len(known) == 0:
            return []
        r = r[known]
        # places, with gaps so that no window holds words of two rows
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        gap = row[first].astype(np.int64) * BLOCK_WORDS
        own = np.searchsorted(first, known, side="right") - 1
        at, begin = known + gap[own], (first + gap)[own]
        end = (np.r_[first[1:], len(row)] + gap)[own]
        out = []
        for t in range(len(self.need)):
            near = np.flatnonzero(self.sets[t][r])
            rare = at[near[self.prefix[t][r[near]]]]
            if len(rare) == 0:
                continue
            # prefix filter: words that a window may hold with a prefix word
            k = np.searchsorted(rare, at[near])
            near = near[np.minimum(np.abs(at[near] - rare[np.minimum(k, len(rare) - 1)]),
                                   np.abs(at[near] - rare[np.maximum(k - 1, 0)])) < BLOCK_WORDS]
            near = near[self._zones(t, at[near], r[near], begin[near], end[near])]
            if len(near) == 0:
                continue
            p, w = at[near], r[near]
            order = np.lexsort((p, w))
            again = w[order[1:]] == w[order[:-1]]
            before = np.full(len(p), -1, dtype=np.int64)
            before[order[1:][again]] = p[order[:-1][again]]
            # windows with the word and no earlier place of it start here
            lo = np.maximum(np.maximum(p - BLOCK_WORDS, before) + 1, begin[near])
            edge = np.r_[lo, p + 1]
            by = np.argsort(edge, kind="stable")
            start, run = np.unique(edge[by], return_index=True)
            common = np.add.reduceat(np.repeat([1, -1], len(p))[by], run).cumsum()
            hit = common >= self.need[t]
            for a, b in zip(np.flatnonzero(hit & ~np.r_[False, hit[:-1]]), np.flatnonzero(hit & ~np.r_[hit[1:], False]) + 1):
                best = a + int(common[a:b].argmax())
                d = np.searchsorted(first + gap, start[best], side="right") - 1
                out.append((int(start[best] - gap[d]), t, float(common[best]) / float(self.size[t])))
        return out

    def _zones(self, t, place, rank, begin, end):
        """Which of a template's words (in the order of their places) lie in
        zones where a window may reach ``need`` common words."""
        zone = np.r_[0, np.cumsum(np.diff(place) >= BLOCK_WORDS)]
        head = np.flatnonzero(np.r_[True, np.diff(zone) > 0])
        tail = np.r_[head[1:], len(zone)] - 1
        # length filter: the words that windows over the zone can hold
        words = np.minimum(place[tail] + BLOCK_WORDS, end[tail]) - np.maximum(place[head] - BLOCK_WORDS + 1, begin[head])
        # positional filter: what the zone and the template have left from
        # their first common word on
        order = np.cumsum(self.sets[t]) - 1
        pair = np.unique(zone.astype(np.int64) * self.vocab_n + rank)
        left = np.bincount(pair // self.vocab_n, minlength=len(head))
        start = np.flatnonzero(np.r_[True, np.diff(pair // self.vocab_n) > 0])
        template_left = self.size[t] - order[pair[start] % self.vocab_n]
        ok = (words >= self.need[t]) & (left >= self.need[t]) & (template_left >= self.need[t])
        return ok[zone]

    @staticmethod
    def _extent(block, win0, wins, first, length, half):
        line = np.searchsorted(win0, block, side="right") - 1
        w = block - win0[line]
        start = first[line] + w * half
        size = np.minimum(BLOCK_WORDS, length[line] - w * half)
        return start, size


def license_scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                 templates=None, phrases=None, threshold: float = THRESHOLD, across_lines: bool = True) -> DataFrame:
    """Scan every whole text of ``df``.  Appends ``n_words``, ``base`` (label
    and first word of every place of a phrase), ``matches`` (label, template,
    first word of the block and containment of every matching block) and
    ``score`` (the largest containment; 1 where a base phrase stands)."""
    templates = list(TEMPLATES if templates is None else templates)
    phrases = list(PHRASES if phrases is None else phrases)
    vocab = sorted({w for t, _ in templates for w in _split(t)})
    freq = word_counts(df, text_col, vocab)

    def make():
        join = _Join(templates, phrases, freq, threshold)
        base_type, match_type = pa_type("base"), pa_type("matches")

        def fn(texts: pa.Array) -> list[pa.Array]:
            n = len(texts)
            n_words, score = np.zeros(n, np.int64), np.zeros(n)
            base: list[list] = [[]] * n
            match: list[list] = [[]] * n
            for lo, hi, data, off, _ in tb.chunks(texts):
                data = tb.lower(data)
                s, e, row = tb.spans(data, off, tb.WORD)
                if len(s) == 0:
                    continue
                n_words[lo:hi] = np.bincount(row, minlength=hi - lo)
                start_of = np.searchsorted(row, np.arange(hi - lo))
                h = tb.span_hash(data, s, e)
                for i, label in sorted(join.base(h, row)):
                    d = row[i]
                    base[lo + d] = base[lo + d] + [{"label": label, "word": i - int(start_of[d])}]
                    score[lo + d] = 1.0
                breaks = np.cumsum(_NEWLINE[data])[s]
                line = breaks + row  # lines grow with line breaks and with rows
                for i, t, c in join.windows(h, row) if across_lines else join.blocks(h, line):
                    d = row[i]
                    match[lo + d] = match[lo + d] + [
                        {"label": join.labels[t], "template": t, "word": i - int(start_of[d]), "containment": c}]
                    score[lo + d] = max(score[lo + d], c)
            return [pa.array(n_words), pa.array(base, base_type), pa.array(match, match_type), pa.array(score)]
        return fn

    return map_text(df, text_col, FIELDS, make, keep)


def pa_type(name: str) -> pa.DataType:
    """Arrow type of an output field."""
    if name == "base":
        return pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    return pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("word", pa.int64()),
                               ("containment", pa.float64())]))
