"""Toxicity: Levenshtein automata on a lexicon trie, and context windows.

The lexicon is learned: from a sample of labelled texts come the words, and
the stems of ``STEM`` letters, that stand in toxic texts far more often than in
others: smoothed log-odds, and a Chernoff bound on such a count arising by
chance that, over all terms, leaves less than one false entry.  Every term with
a letter that passes both is an entry, however short or long.  A trie of
these entries is intersected with the Levenshtein automaton of one edit
(entries of ``FUZZY_LENGTH`` letters or more; shorter ones match as they are)
and made deterministic as far as texts lead into it; letters are code points,
so an edit is one letter in any script.  Running it over the words of a text finds
every entry, misspelled ones included; almost every other word leaves it after
two or three letters.

A hit's weight is learned for its entry, its distance (0 or 1) and whether it
is quoted (inside quotation marks on its line), again as log-odds on the
sample, so a common word that merely resembles an entry weighs nothing and a
quoted insult weighs less than one that is not.  Weights add up within windows
of ``WINDOW`` words; the best window, the rest of the weights and the number of
distinct entries go into a logistic regression fitted on the sample.

What is collected: the terms that pass, whose number the sample bounds, their
cells, and three numbers for each row of the sample (``TRAIN_ROWS`` on
average).  The entries are shipped to the tasks, which make the automaton.
Scoring is one Arrow map over the whole table, without a shuffle.

Edge cases: null and empty texts have no hits and get the score of a text
without hits; a document with both labels counts as toxic; without both
classes among the labels every score is the share of toxic ones (0 without
any); repeated rows are scored one by one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .pieces import HashIndex
from .sampling import draw, threshold
from .tables import drop, materialize
from .textmap import col, map_text

#: Labelled rows to learn from, on average (all, if there are fewer).
TRAIN_ROWS = 12_000
STEM = (4, 5, 6)
FUZZY_LENGTH = 5
WINDOW = 12
#: Least log-odds and least number of toxic texts of an entry.
MIN_LOG_ODDS, MIN_TEXTS = 2.5, 3
#: States that an automaton keeps from one run to the next.
STATES = 100_000

FIELDS = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("window_score", T.DoubleType()),
    T.StructField("hits", T.ArrayType(T.StructType([
        T.StructField("term", T.StringType()), T.StructField("distance", T.IntegerType()),
        T.StructField("word", T.LongType()), T.StructField("quoted", T.BooleanType())]))),
])
_HIT = pa.list_(pa.struct([("term", pa.string()), ("distance", pa.int32()), ("word", pa.int64()), ("quoted", pa.bool_())]))
_LETTERS = tb.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def _code_points(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and word spans in places of code points."""
    first = data & 0xC0 != 0x80
    if first.all():
        return data.astype(np.int32), start, end
    at = np.flatnonzero(first)
    code = data[at].astype(np.int32)
    for size, least, most in ((2, 0xC0, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF7)):
        own = np.flatnonzero((code >= least) & (code <= most) & (at + size <= len(data)))
        c = code[own] - least
        for k in range(1, size):
            c = c << 6 | (data[at[own] + k] & 0x3F).astype(np.int32)
        # beyond the tests of the longer sizes; undone below
        code[own] = c + (1 << 24)
    code = np.where(code >= 1 << 24, code - (1 << 24), code)
    before = np.r_[0, np.cumsum(first)]
    return code, before[start], before[end]


class LexiconAutomaton:
    """Lexicon trie intersected with the Levenshtein automaton of one edit.

    ``entries``: words, or stems written with a final ``*`` that match every
    word they begin.  A state is a set of (trie node, edits so far) with the
    best stem that has ended; state 0 is the dead end and state 1 the start.
    States are made when a text first leads to them and kept, up to ``STATES``
    between two runs: an automaton of all states would grow with the product of
    lexicon and alphabet, a text meets few of them.  Nodes above short entries
    only, which match as they are, are never reached with an edit.
    """

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.child: list[dict[int, int]] = [{}]
        self.word_at, self.stem_at, self.fuzzy = [-1], [-1], [False]
        for k, entry in enumerate(entries):
            bare = entry.rstrip("*")
            node, path = 0, [0]
            for c in map(ord, bare):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word_at.append(-1)
                    self.stem_at.append(-1)
                    self.fuzzy.append(False)
                node = self.child[node][c]
                path.append(node)
            (self.stem_at if entry.endswith("*") else self.word_at)[node] = k
            if len(bare) >= FUZZY_LENGTH:
                for n in path:
                    self.fuzzy[n] = True
        self.limit = [1 if len(e.rstrip("*")) >= FUZZY_LENGTH else 0 for e in entries]
        letters = sorted({c for nexts in self.child for c in nexts})
        self.letters = [None, *letters]
        # class 0: no letter of the lexicon; the last place stands for all code points beyond
        self.cls = np.zeros(max([0x7F, *letters]) + 2, dtype=np.int32)
        self.cls[letters] = np.arange(1, len(letters) + 1)
        self.width = len(self.letters)
        self._start()

    def __reduce__(self):
        return LexiconAutomaton, (self.entries,)

    def _start(self) -> None:
        self.ids: dict = {}
        self.states: list = []
        self.entry = self.edits = np.zeros(0, np.int64)
        self.absorb = np.zeros(0, bool)
        self.index, self.target = HashIndex(16), np.zeros(0, np.int64)
        self._number((frozenset(), None))
        self._number(self._state(self._closed({0: 0}), None))
        self._describe()

    def _closed(self, states: dict) -> frozenset:
        # a letter of the lexicon may be left out; fewer edits win
        for node in [n for n, e in states.items() if e == 0]:
            for nxt in self.child[node].values():
                if self.fuzzy[nxt]:
                    states.setdefault(nxt, 1)
        return frozenset(states.items())

    def _best(self, states: frozenset, at: list[int]) -> tuple[int, int] | None:
        return min(((e, at[n]) for n, e in states if at[n] >= 0 and e <= self.limit[at[n]]), default=None)

    def _state(self, states: frozenset, stem: tuple[int, int] | None) -> tuple:
        # once the best stem that has ended is exact, or nothing else can match
        # any more, whatever follows is a hit
        ended = min((x for x in (stem, self._best(states, self.stem_at)) if x), default=None)
        return (frozenset() if ended and ended[0] == 0 else states, ended)

    def _number(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
        return self.ids[state]

    def _describe(self) -> None:
        """What the states that are new since the last call accept."""
        new = self.states[len(self.absorb):]
        accept = [min((x for x in (stem, self._best(states, self.word_at)) if x), default=(0, -1)) for states, stem in new]
        self.entry = np.r_[self.entry, np.array([k for _, k in accept], np.int64)]
        self.edits = np.r_[self.edits, np.array([e for e, _ in accept], np.int64)]
        self.absorb = np.r_[self.absorb, np.array([not states for states, _ in new], bool)]

    def _follow(self, step: int) -> int:
        """The state after a state and a letter class (as one number)."""
        states, stem = self.states[step // self.width]
        letter = self.letters[step % self.width]
        nxt: dict[int, int] = {}
        for node, e in states:
            hit = self.child[node].get(letter)
            if hit is not None and (e == 0 or self.fuzzy[hit]) and nxt.get(hit, 2) > e:
                nxt[hit] = e
            if e == 0:
                for other in (node, *self.child[node].values()):
                    if self.fuzzy[other]:
                        nxt.setdefault(other, 1)
        return self._number(self._state(self._closed(nxt), stem))

    def _next(self, step: np.ndarray) -> np.ndarray:
        h = tb.mix(step.astype(np.uint64) + np.uint64(1))
        known = self.index.find(h)
        new = np.flatnonzero(known < 0)
        if len(new):
            one, at = np.unique(step[new], return_index=True)
            if self.index.n + len(one) > self.index.limit:
                self._widen(len(one))
            self.target = np.r_[self.target, np.array([self._follow(x) for x in one.tolist()], np.int64)]
            self.index.add(h[new[at]])
            self._describe()
            known = self.index.find(h)
        return self.target[known]

    def _widen(self, more: int) -> None:
        """A larger index with the same numbers."""
        old = self.index
        self.index = HashIndex(int(old.n + more).bit_length() + 2)
        full = np.flatnonzero(old.keys)
        self.index.add(old.keys[full[np.argsort(old.vals[full])]])

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, entry, distance) of every word that is a hit."""
        if len(self.states) > STATES:
            self._start()
        code, start, end = _code_points(data, start, end)
        cls = self.cls[np.minimum(code, len(self.cls) - 1)]
        state = np.ones(len(start), dtype=np.int64)
        live, at = np.arange(len(start)), start.copy()
        while len(live):
            s = self._next(state[live] * self.width + cls[at])
            state[live] = s
            at = at + 1
            go = (s != 0) & ~self.absorb[s] & (at < end[live])
            live, at = live[go], at[go]
        hit = np.flatnonzero(self.entry[state] >= 0)
        return hit, self.entry[state[hit]], self.edits[state[hit]]


#: One automaton for each lexicon, kept by a Python worker from task to task.
_AUTOMATA: dict[tuple, LexiconAutomaton] = {}


def automaton(entries: list[str]) -> LexiconAutomaton:
    key = tuple(entries)
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = LexiconAutomaton(entries)
    return _AUTOMATA[key]


def _plain(data: np.ndarray) -> np.ndarray:
    """Lower case, with typographic marks (U+2000 to U+203F) and the signs of
    Latin-1 (U+0080 to U+00BF) as blanks."""
    data = tb.lower(data)
    sign = np.flatnonzero(data == 0xC2)
    mark = np.flatnonzero(data == 0xE2)
    mark = mark[data[np.minimum(mark + 1, len(data) - 1)] == 0x80]
    for at, size in ((sign, 2), (mark, 3)):
        for k in range(size):
            data[np.minimum(at + k, len(data) - 1)] = 0x20
    return data


_QUOTE = tb.byte_class((0x22, 0x22))
_NEWLINE = tb.byte_class((0x0A, 0x0A))


def _quoted(data: np.ndarray, off: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each byte position stands inside quotation marks on its line."""
    toggles = np.r_[0, np.cumsum(_QUOTE[data])]
    two, three = data[:-1].astype(np.int64) << 8 | data[1:], None
    opens, closes = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    opens[:-1] += two == 0xC2AB
    closes[:-1] += two == 0xC2BB
    if len(data) > 2:
        three = two[:-1] << 8 | data[2:]
        opens[:-2] += three == 0xE2809C
        closes[:-2] += three == 0xE2809D
    depth = np.r_[0, np.cumsum(opens - closes)]
    breaks = np.flatnonzero(_NEWLINE[data]) + 1
    before = np.searchsorted(breaks, at, side="right") - 1
    line = np.maximum(off[row], np.where(before >= 0, breaks[np.maximum(before, 0)], 0) if len(breaks) else 0)
    return ((toggles[at] - toggles[line]) % 2 == 1) | (depth[at] - depth[line] > 0)


class Scanner:
    """Hits of all rows of a chunk as flat arrays."""

    def __init__(self, entries: list[str]):
        self.entries = entries

    def hits(self, data: np.ndarray, off: np.ndarray):
        """(row, word number in its row, entry, distance, quoted)."""
        z = np.zeros(0, np.int64)
        plain = _plain(data)
        s, e, row = tb.spans(plain, off, _LETTERS)
        if not self.entries or len(s) == 0:
            return z, z, z, z, np.zeros(0, bool)
        w, entry, dist = automaton(self.entries).run(plain, s, e)
        number = w - np.searchsorted(row, row[w])
        return row[w], number, entry, dist, _quoted(data, off, row[w], s[w]) if len(w) else np.zeros(0, bool)


def evidence(rows: int, row, number, entry, dist, quoted, weight: np.ndarray) -> np.ndarray:
    """Per row: best window, all weights, distinct entries that weigh."""
    out = np.zeros((rows, 3))
    w = weight[entry, dist, quoted.astype(np.int64)]
    keep = w > 0
    row, number, entry, w = row[keep], number[keep], entry[keep], w[keep]
    if len(row):
        key = row * (1 << 40) + number
        total = np.r_[0.0, np.cumsum(w)]
        last = np.searchsorted(key, key + WINDOW, side="left")
        np.maximum.at(out[:, 0], row, total[last] - total[:-1])
        np.add.at(out[:, 1], row, w)
        each = np.unique(row * (1 << 20) + entry)
        np.add.at(out[:, 2], each >> 20, 1.0)
    return out


def _features(x: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(x)), np.log1p(x)]


def _log_odds(c1, c0, n1, n0):
    return math.log((c1 + 0.5) / (n1 + 1.0)) - math.log((c0 + 0.5) / (n0 + 1.0))


def _fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps (a few numbers per row)."""
    f, beta = _features(x), np.zeros(x.shape[1] + 1)
    reg = l2 * np.eye(len(beta))
    reg[0, 0] = 1e-6
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(f @ beta, -30, 30)))
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + reg, f.T @ (y - p) - reg @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class ToxicityModel:
    """Lexicon, weights by (entry, distance, quoted) and the regression."""

    def __init__(self, entries: list[str], weight: np.ndarray, beta: np.ndarray | None, constant: float = 0.0,
                 scan: Scanner | None = None):
        self.entries, self.weight, self.beta, self.constant = entries, weight, beta, constant
        self.scan = scan or Scanner(entries)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), self.constant)
        return 1.0 / (1.0 + np.exp(-np.clip(_features(x) @ self.beta, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", most: int = TRAIN_ROWS) -> DataFrame:
    """(text, y) of a bounded sample of the labelled rows whose id fulfils
    ``allowed``, chosen by a hash of the id."""
    lab = (labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y"))
           .filter("id is not null and y in (0, 1)").withColumnRenamed("id", id_col).filter(allowed)
           .groupBy(id_col).agg(F.max("y").alias("y")))
    cut = threshold(lab.count(), most)
    few = lab.filter(draw(id_col) < cut)
    # about ``most`` rows of two numbers: their size is bounded by that parameter
    return (docs.select(col(id_col).alias(id_col), col(text_col).cast("string").alias("text"))
            .join(F.broadcast(few), id_col).select("text", "y"))


def _terms(words: set[str]) -> set[str]:
    out = set(words)
    for w in words:
        out.update(w[:k] + "*" for k in STEM if len(w) > k)
    return out


def _term_counts(train: DataFrame) -> DataFrame:
    """Texts of either class that hold each word or stem."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for b in batches:
            ys = b.column(1).to_pylist()
            for lo, _, data, off, _ in tb.chunks(b.column(0)):
                data = _plain(data)
                s, e, row = tb.spans(data, off, _LETTERS)
                whole = data.tobytes()
                own: dict[int, set] = {}
                for r, x, z in zip(row.tolist(), s.tolist(), e.tolist()):
                    own.setdefault(r, set()).add(whole[x:z])
                for r, words in own.items():
                    found[ys[lo + r]].update(_terms({w.decode(errors="replace") for w in words}))
        terms = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([
            pa.array(terms, pa.string()), pa.array([found[1][t] for t in terms], pa.int64()),
            pa.array([found[0][t] for t in terms], pa.int64())], names=["term", "c1", "c0"])

    return train.select("text", "y").mapInArrow(run, "term string, c1 long, c0 long").groupBy("term").agg(
        F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def _lexicon(train: DataFrame, n1: int, n0: int) -> list[str]:
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1.0)) - F.log((F.col("c0") + 0.5) / (n0 + 1.0))
    # every term that is tested counts for the bound, whatever its labels
    counts = _term_counts(train).filter((F.col("c1") + F.col("c0") >= MIN_TEXTS) & F.col("term").rlike("[^0-9*]"))
    counts = materialize(counts, "toxicity-terms")
    # a term that has nothing to do with the label is toxic n1 / (n1 + n0) of the time
    n, p = F.col("c1") + F.col("c0"), n1 / (n1 + n0)
    q = F.col("c1") / n
    surprise = n * (q * F.log(q / p) + F.when(F.col("c0") > 0, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0))
    best = counts.filter((F.col("c1") >= MIN_TEXTS) & (odds >= MIN_LOG_ODDS) & (surprise >= math.log(max(1, counts.count())) + 1.0)).collect()
    # of about equal counts the longest comes first; a word beats the stem it equals
    rows = sorted(((round(math.log(r["c1"]) / 0.05), len(r["term"].rstrip("*")), not r["term"].endswith("*"), r["term"]) for r in best),
                  key=lambda r: (-r[0], -r[1], not r[2], r[3]))
    taken: list[str] = []
    bares, stems, begins = set(), set(), set()  # of the taken terms
    for _, _, _, term in rows:
        bare, stem = term.rstrip("*"), term.endswith("*")
        if bare in bares or (stem and bare in begins) or any(bare[:k] in stems for k in range(1, len(bare) + 1)):
            continue
        taken.append(term)
        bares.add(bare)
        if stem:
            stems.add(bare)
        begins.update(bare[:k] for k in range(1, len(bare) + 1))
    return sorted(taken)


def fit(train: DataFrame) -> ToxicityModel:
    """Learn from rows (text, y)."""
    # equal texts count once, as toxic if one of them is; three jobs read the rows
    train = materialize(train.filter("text is not null").groupBy("text").agg(F.max("y").alias("y")), "toxicity-rows")
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        drop(train)
        return ToxicityModel([], np.zeros((1, 2, 2)), None, 1.0 if n1 else 0.0)
    entries = _lexicon(train, n1, n0)
    scan = Scanner(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells: list[list[int]] = [[] for _ in range(b.num_rows)]
            for lo, _, data, off, _ in tb.chunks(b.column(0)):
                row, number, entry, dist, quoted = scan.hits(data, off)
                for r, *cell in zip(row.tolist(), number.tolist(), entry.tolist(), dist.tolist(), quoted.tolist()):
                    cells[lo + r] += [int(x) for x in cell]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.list_(pa.int32())), b.column(1)], names=["cells", "y"])

    # four numbers a hit for each row of the bounded sample
    rows = train.select("text", "y").mapInArrow(run, "cells array<int>, y int").collect()
    drop(train)
    y = np.array([r["y"] for r in rows], dtype=float)
    each = [np.array(r["cells"], dtype=np.int64).reshape(-1, 4) for r in rows]
    count = np.zeros((2, max(1, len(entries)), 2, 2))
    for hits, label in zip(each, y):
        for entry, dist, quoted in {tuple(h[1:]) for h in hits.tolist()}:
            count[int(label), entry, dist, quoted] += 1
    weight = np.zeros(count.shape[1:])
    for cell in np.ndindex(*weight.shape):
        c1, c0 = count[1][cell], count[0][cell]
        if c1 + c0:
            weight[cell] = max(0.0, _log_odds(c1, c0, n1, n0) - 1.0)
    # cells without a case: a misspelling weighs like its entry, a quoted hit half of that
    for k in range(weight.shape[0]):
        if not count[:, k, 1, 0].sum():
            weight[k, 1, 0] = 0.75 * weight[k, 0, 0]
        for d in (0, 1):
            if not count[:, k, d, 1].sum():
                weight[k, d, 1] = 0.5 * weight[k, d, 0]
    x = np.concatenate([evidence(1, np.zeros(len(h), np.int64), h[:, 0], h[:, 1], h[:, 2], h[:, 3] > 0, weight)
                        for h in each])
    return ToxicityModel(entries, weight, _fit_logistic(x, y), scan=scan)


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends ``score`` (0 to 1), ``window_score`` and ``hits``."""
    def make():
        scan = model.scan

        def fn(texts: pa.Array) -> list[pa.Array]:
            n = len(texts)
            x, hits = np.zeros((n, 3)), [[]] * n
            for lo, hi, data, off, _ in tb.chunks(texts):
                found = scan.hits(data, off)
                x[lo:hi] = evidence(hi - lo, *found, model.weight)
                for r, number, entry, dist, quoted in zip(*(f.tolist() for f in found)):
                    if model.weight[entry, dist, int(quoted)] > 0:
                        hits[lo + r] = hits[lo + r] + [{"term": model.entries[entry], "distance": dist,
                                                        "word": number, "quoted": quoted}]
            return [pa.array(model.score(x)), pa.array(x[:, 0]), pa.array(hits, _HIT)]
        return fn

    return map_text(df, text_col, FIELDS, make, keep)


def keep_clean(df: DataFrame, model: ToxicityModel, text_col: str = "text", reject_from: float = 0.5) -> DataFrame:
    """``df`` without the documents that score ``reject_from`` or more."""
    def make():
        scan = model.scan

        def fn(texts: pa.Array) -> list[pa.Array]:
            x = np.zeros((len(texts), 3))
            for lo, hi, data, off, _ in tb.chunks(texts):
                x[lo:hi] = evidence(hi - lo, *scan.hits(data, off), model.weight)
            return [pa.array(model.score(x))]
        return fn

    scored = map_text(df, text_col, T.StructType([T.StructField("__llm_score", T.DoubleType())]), make)
    return scored.filter(F.col("__llm_score") < reject_from).drop("__llm_score")
