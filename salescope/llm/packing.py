"""Packing of tokenized documents into training windows by multiway differencing.

A document's token ids (an end id after them) are cut at whole windows; each
whole window is a sequence of its own.  The rests are gathered into groups of
``GROUP`` windows, the last rest of a group cut so that it fills the group, and
a group is divided by Karmarkar-Karp multiway differencing: every rest starts
as a partial partition of k windows, one of them holding it; the two partial
partitions of the largest imbalance are merged again and again, the fullest
window of one with the emptiest of the other, until one partition is left,
whose windows are nearly equal.  Windows beyond the capacity then give the end
of their longest pieces to windows with room (``cut=False``: pieces stay
whole); while a window is still beyond the capacity, the window count rises by
one and the group is divided anew.  The last group of a task has no document
left to fill it: its tokens beyond whole windows are cut into sequences whose
lengths are powers of two, which need no padding.

Groups form inside a task from the rows it reads, so nothing is shuffled and a
task holds one group (``GROUP`` windows) and one slice of text, or the longest
single text.  A sequence id is the number of the partition times 2^33 plus a
counter.  A task that runs again reads the same files and returns the same
rows; rows that come out of a shuffle must be written before (``materialize``).

The library tokenizes each distinct word part of a task once.  Its normalizer
and splitter never join across ASCII white space, after an ASCII digit, or at
an ASCII border of letters and other characters (but an apostrophe stays with
the letters behind it, and a word with ``<|`` stays whole, since it may hold a
special token), so the ids of a text are those of its parts (tests compare with
whole texts).  Parts are told apart by 64-bit hashes.

Edge cases: a null or empty text has the end id alone; every row has at least
one piece, repeated rows have pieces each; an empty table gives no rows; input
columns named like an appended one are replaced.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .pieces import HashIndex, number_spans
from .textmap import SLICE_BYTES, col, without

CAPACITY = 2048
#: Windows that are divided together; bounds what a task holds.
GROUP = 64
END_ID = 1
#: Bytes of new words that go to the tokenizer library at once.
LEARN_BYTES = 1 << 20

PIECES = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                       T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
                       T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType())])


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's content (a parameter; by default the public one)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


# -- tokens ------------------------------------------------------------------

_LETTER = tb.byte_class((0x41, 0x5A), (0x61, 0x7A))
_DIGIT = tb.byte_class((0x30, 0x39))


def parts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the parts that can be tokenized one by one."""
    start, end, row = tb.spans(data, off, tb.NOT_SPACE)
    if len(data) < 2:
        return start, end, row
    a, b = data[:-1], data[1:]
    border = (_LETTER[a] != _LETTER[b]) & (a != ord("'")) | _DIGIT[a] | _DIGIT[b]
    border &= (a < 0x80) & (b < 0x80) & tb.NOT_SPACE[a] & tb.NOT_SPACE[b]
    mark = np.flatnonzero((a == ord("<")) & (b == ord("|")))
    for s in np.unique(np.searchsorted(start, mark, side="right") - 1):
        border[start[s]:end[s] - 1] = False
    edge = off[(off > 0) & (off < len(data))] - 1
    border[edge] = False  # rows may meet without white space: a part starts there already
    inner = np.flatnonzero(border)
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    first[start] = first[inner + 1] = last[end - 1] = last[inner] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


class Tokens:
    """Ids of whole rows; keeps the ids of up to a million distinct parts as
    flat arrays, then starts anew."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_str(spec)
        words = self.model.get_vocab()
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self, bits: int = 21) -> None:
        self.index = HashIndex(bits)
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Ids of new distinct parts.  Parts of ASCII letters are one word
        each: many go to the library as one text, whose ids are cut after the
        pieces that end a word."""
        letters = np.r_[0, np.cumsum(_LETTER[data])]
        plain = letters[end] - letters[start] == end - start
        n = np.zeros(len(start), np.int64)
        ids, order = [], []
        for which in self._portions(np.flatnonzero(plain), start, end):
            size = end[which] - start[which] + 1
            text = data[np.minimum(tb.ragged(start[which], size), len(data) - 1)]
            text[np.cumsum(size) - 1] = 0x20
            got = np.array(self.model.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            n[which] = np.diff(np.r_[0, np.flatnonzero(self.ends_word[got]) + 1])
            ids.append(got)
            order.append(which)
        raw = data.tobytes()
        for which in self._portions(np.flatnonzero(~plain), start, end):
            words = [raw[s:e].decode("utf-8", errors="replace") for s, e in zip(start[which].tolist(), end[which].tolist())]
            got = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
            n[which] = [len(i) for i in got]
            ids.append(np.array([i for g in got for i in g], np.uint32))
            order.append(which)
        order = np.concatenate(order)
        at = np.zeros(len(start), np.int64)
        at[order] = np.cumsum(n[order]) - n[order]
        self.start = np.r_[self.start, len(self.ids) + at]
        self.length = np.r_[self.length, n]
        self.ids = np.concatenate([self.ids, *ids])

    @staticmethod
    def _portions(which: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        size = np.cumsum(end[which] - start[which])
        return np.split(which, np.flatnonzero(np.diff(size // LEARN_BYTES)) + 1) if len(which) else []

    @staticmethod
    def _lowered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A-Z lower-cased, as the normalizer does, but not in what may hold a
        special token."""
        text = tb.lower(data)
        mark = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        for s in np.unique(np.searchsorted(start, mark, side="right") - 1):
            text[start[s]:end[s]] = data[start[s]:end[s]]
        return text

    def rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets per row) of whole texts, each with the end id."""
        start, end, row = parts(data, off)
        n = len(off) - 1
        if self.index.n + len(start) > self.index.limit:
            self.clear()
        if len(start) > self.index.limit:  # one very long text: it gets a table of its own size
            self.clear(int(len(start)).bit_length() + 1)
        text = self._lowered(data, start, end)
        which, new = number_spans(self.index, text, start, end)
        if len(new):
            self.learn(text, start[new], end[new])
        size = self.length[which]
        out = np.r_[0, np.cumsum(np.bincount(row, weights=size, minlength=n).astype(np.int64) + 1)]
        ids = np.full(out[-1], END_ID, np.uint32)
        body = np.ones(out[-1], bool)
        body[out[1:] - 1] = False
        ids[body] = self.ids[tb.ragged(self.start[which], size)]
        return ids, out


#: One tokenizer for each file, kept by a Python worker from task to task.
_TOKENS: dict[int, Tokens] = {}


def tokens_of(spec: str) -> Tokens:
    key = hash(spec)
    if key not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[key] = Tokens(spec)
    return _TOKENS[key]


# -- differencing ------------------------------------------------------------

def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The numbers of ``sizes`` dealt to ``k`` sets of nearly equal sums.

    A partial partition is k sums in falling order, each with its set; sets
    are nodes of a binary tree, so a merge costs k steps."""
    n = len(sizes)
    left, right = [0] * (n + 1), [0] * (n + 1)
    heap = []
    for i, s in enumerate(sizes):
        sums, node = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums[0], node[0] = s, i + 1
        heap.append((-int(s), i, sums, node))
    heapq.heapify(heap)
    for turn in range(n, 2 * n - 1):
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        node, both = x + y, np.flatnonzero((x > 0) & (y > 0))
        node[both] = np.arange(len(left), len(left) + len(both))
        left += x[both].tolist()
        right += y[both].tolist()
        order = np.argsort(-sums, kind="stable")
        sums, node = sums[order], node[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums, node))
    out = []
    for top in (heap[0][3].tolist() if heap else [0] * k):
        found, todo = [], [top] if top else []
        while todo:
            t = todo.pop()
            if t <= n:
                found.append(t - 1)
            else:
                todo += [left[t], right[t]]
        out.append(sorted(found))
    return out


def _level(windows: list[list[tuple[int, int, int]]], capacity: int) -> None:
    """Windows beyond the capacity give the ends of their longest pieces to
    windows with room; pieces are (item, start, length)."""
    free = [[capacity - sum(p[2] for p in w), w] for w in windows]
    room = [f for f in free if f[0] > 0]
    for over, window in free:
        while over < 0 and room:
            j = max(range(len(window)), key=lambda i: window[i][2])
            item, start, length = window[j]
            cut = min(-over, length, room[-1][0])
            if cut == length:
                window.pop(j)
            else:
                window[j] = (item, start, length - cut)
            room[-1][1].append((item, start + length - cut, cut))
            over += cut
            room[-1][0] -= cut
            if not room[-1][0]:
                room.pop()


def divide(sizes: list[int], capacity: int = CAPACITY, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start in the item, length) that hold all items,
    none above ``capacity``; items longer than it must be cut before."""
    k = max(1, sum(sizes) // capacity)
    while True:
        windows = [[(i, 0, sizes[i]) for i in w] for w in differencing(sizes, k)]
        if cut:
            _level(windows, capacity)
        if max(sum(p[2] for p in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += 1


# -- a task ------------------------------------------------------------------

class _Group:
    """Rests of documents that wait to be divided together."""

    def __init__(self, capacity: int, group: int, cut: bool, first_sequence: int):
        self.capacity, self.full, self.cut, self.sequence = capacity, capacity * group, cut, first_sequence
        self.clear()

    def clear(self) -> None:
        self.rests: list[tuple] = []   # (row, start in the document, tokens of the document, ids)
        self.total = 0

    def _emit(self, out: list[tuple], pieces: list[tuple]) -> None:
        at = 0
        for row, start, tokens, ids in pieces:
            out.append((row, start, tokens, self.sequence, at, ids))
            at += len(ids)
        self.sequence += 1

    def add(self, row, ids: np.ndarray, out: list[tuple]) -> None:
        """One document: its whole windows go out, its rest waits."""
        n, c = len(ids), self.capacity
        whole = n - n % c
        for s in range(0, whole, c):
            self._emit(out, [(row, s, n, ids[s:s + c])])
        rest, at = ids[whole:], whole
        if self.cut and len(rest) >= self.full - self.total:
            take = self.full - self.total
            self._wait(row, at, n, rest[:take])
            self.flush(out)
            rest, at = rest[take:], at + take
        self._wait(row, at, n, rest)
        if not self.cut and self.total >= self.full:
            self.flush(out)

    def _wait(self, row, at: int, tokens: int, ids: np.ndarray) -> None:
        if len(ids):
            self.rests.append((row, at, tokens, ids))
            self.total += len(ids)

    def flush(self, out: list[tuple]) -> None:
        if self.rests:
            for window in divide([len(r[3]) for r in self.rests], self.capacity, self.cut):
                rests = self.rests
                self._emit(out, [(rests[i][0], rests[i][1] + s, rests[i][2], rests[i][3][s:s + n])
                                 for i, s, n in sorted(window)])
        self.clear()

    def finish(self, out: list[tuple]) -> None:
        """The task's last group: what is beyond whole windows goes out in
        sequences whose lengths are powers of two."""
        while self.cut and self.total % self.capacity:
            want = 1 << ((self.total % self.capacity).bit_length() - 1)
            pieces = []
            while want:
                row, start, tokens, ids = self.rests.pop()
                take = min(want, len(ids))
                if take < len(ids):
                    self.rests.append((row, start, tokens, ids[:-take]))
                pieces.append((row, start + len(ids) - take, tokens, ids[len(ids) - take:]))
                want -= take
                self.total -= take
            self._emit(out, pieces[::-1])
        self.flush(out)


def pack(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY,
         group: int = GROUP, cut: bool = True, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: the columns ``keep`` of its document and

    * ``start``, ``length``: the piece's place among the document's tokens;
    * ``doc_tokens``: the document's tokens with the end id;
    * ``sequence_id``, ``offset``: its sequence and its place there;
    * ``ids``: the token ids, little-endian unsigned 32-bit.

    ``tokenizer`` is the content of a tokenizer file (``tokenizer_json``)."""
    shipped = df.sparkSession.sparkContext.broadcast(tokenizer or tokenizer_json())
    kept = without(df.select(*[col(c) for c in (keep if keep is not None else df.columns)]), PIECES.names)
    source = df.select(*[col(c) for c in kept], col(text_col).cast("string").alias("__llm_text"))
    schema = T.StructType([source.schema[i] for i in range(len(kept))] + list(PIECES.fields))
    names = schema.names

    def rows_of(pending: list[pa.RecordBatch], out: list[tuple]) -> pa.RecordBatch:
        table = pa.Table.from_batches(pending).combine_chunks()
        base = np.cumsum([0, *[len(b) for b in pending]])
        at = pa.array([int(base[b]) + r for (b, r), *_ in out], pa.int64())
        own = [pa.concat_arrays(table.column(i).take(at).chunks) for i in range(len(kept))]
        number = [pa.array([o[i] for o in out], pa.int64()) for i in (1, 2, 3, 4)]
        ids = pa.array([o[5].tobytes() for o in out], pa.binary())
        length = pa.array([len(o[5]) for o in out], pa.int64())
        return pa.RecordBatch.from_arrays([*own, number[0], length, number[1], number[2], number[3], ids], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(shipped.value)
        groups = _Group(capacity, group, cut, TaskContext.get().partitionId() << 33)
        pending: list[pa.RecordBatch] = []
        row_type = pa.schema([])
        for batch in batches:
            row_type = pa.schema(list(batch.schema)[:len(kept)]) if kept else pa.schema([("__row", pa.int32())])
            for lo, hi, data, off, _ in tb.chunks(batch.column(len(kept)), SLICE_BYTES // 4):
                own = [c.slice(lo, hi - lo) for c in batch.columns[:len(kept)]] or [pa.nulls(hi - lo, pa.int32())]
                pending.append(pa.RecordBatch.from_arrays(own, schema=row_type))
                ids, ends = tokens.rows(data, off)
                out: list[tuple] = []
                for r in range(hi - lo):
                    groups.add((len(pending) - 1, r), ids[ends[r]:ends[r + 1]], out)
                if out:
                    yield rows_of(pending, out)
                pending = _still_waiting(pending, groups)
        out = []
        groups.finish(out)
        if out:
            yield rows_of(pending, out)

    return source.mapInArrow(run, schema)


def _still_waiting(pending: list[pa.RecordBatch], groups: _Group) -> list[pa.RecordBatch]:
    """The rows of the documents whose rests wait, in one batch; the rests'
    ids are copied, so that the slice they come from can go."""
    if not groups.rests:
        return []
    table = pa.Table.from_batches(pending).combine_chunks()
    base = np.cumsum([0, *[len(b) for b in pending]])
    at = [int(base[b]) + r for (b, r), *_ in groups.rests]
    groups.rests = [((0, i), start, n, ids.copy() if ids.base is not None else ids)
                    for i, (_, start, n, ids) in enumerate(groups.rests)]
    return table.take(pa.array(at, pa.int64())).combine_chunks().to_batches()


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per sequence: its ids in order (binary), the pieces' lengths
    (the borders that attention must not cross) and its padding.  A sequence
    holds at most ``capacity`` tokens, so a group is bounded."""
    g = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    power = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long") == n
    return g.select("sequence_id", ids.alias("ids"), F.col("p.length").alias("lengths"), n.alias("n_tokens"),
                    F.when(power, 0).otherwise(capacity - n).cast("long").alias("padding"))
