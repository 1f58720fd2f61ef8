"""Token counts without encoding: dynamic programming over a trie.

The distinct pre-tokens of the texts are inserted in a trie of characters.  The unigram forward score of a node (best score of its path, and
how many tokens that segmentation has) is computed once, when the node is
made, from the forward scores of its ancestors: an Aho-Corasick state per node names
the pieces that end there.  Pre-tokens that share a prefix share that work.  A pre-token's terminal node gives its number of tokens, and
a document's count is the sum over its pre-tokens.  The trie and
the terminal counts are kept by the Python worker and started anew at a fixed
size, so memory is bounded while nothing is left out.  Counts equal the lengths of ``sentencepiece.encode``
with the same table.

Edge cases: null and empty texts have 0 tokens; repeated rows count alike; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textbytes as tb
from .pieces import LITERAL, HashIndex, PieceTable, escape, number_spans, pretokens, with_prefix
from .textmap import map_text

MAX_NODES = 400_000


class PieceStates:
    """Aho-Corasick states of the pieces: for a state and a character the next
    state, and for a state the pieces that end there (length, score)."""

    def __init__(self, table: PieceTable):
        self.goto: list[dict[str, int]] = [{}]
        self.out: list[list[tuple[int, int]]] = [[]]
        for p, (_, s) in table.pieces.items():
            state = 0
            for c in p:
                nxt = self.goto[state].get(c)
                if nxt is None:
                    nxt = self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.out.append([])
                state = nxt
            self.out[state].append((len(p), s))
        self.fail = [0] * len(self.goto)
        level = list(self.goto[0].values())
        while level:
            below = []
            for state in level:
                for c, nxt in self.goto[state].items():
                    self.fail[nxt] = self.next(self.fail[state], c)
                    self.out[nxt] = self.out[nxt] + self.out[self.fail[nxt]]
                    below.append(nxt)
            level = below

    def next(self, state: int, c: str) -> int:
        while (nxt := self.goto[state].get(c)) is None:
            if state == 0:
                return 0
            state = self.fail[state]
        return nxt


class CountTrie:
    """Trie of pre-tokens with the forward score of every node, and the
    terminal counts of up to a million pre-tokens by hash."""

    def __init__(self, table: PieceTable):
        self.table, self.states = table, PieceStates(table)
        self.clear()
        self.forget()

    def clear(self) -> None:
        """An empty trie."""
        self.child: list[dict[str, int]] = [{}]
        self.score, self.tokens, self.state = [0], [0], [0]

    def forget(self) -> None:
        """No terminal counts."""
        self.index = HashIndex()
        self.counts = np.zeros(0, np.int64)

    def insert(self, text: str, original: str) -> int:
        """Insert a pre-token; the tokens of its best segmentation."""
        if len(self.score) > MAX_NODES:
            self.clear()
        path, node, child = [0], 0, self.child
        for i, c in enumerate(text):
            key = c if c != LITERAL else c + original[i]
            nxt = child[node].get(key)
            if nxt is None:
                nxt = child[node][key] = self._grow(c, original[i], path)
            path.append(nxt)
            node = nxt
        return self.tokens[node]

    def _grow(self, c: str, original: str, path: list[int]) -> int:
        """New node below the path, with its forward score."""
        score, tokens, node = self.score, self.tokens, path[-1]
        state = self.states.next(self.state[node], c)
        if c in self.table.single:
            best, count, depth = -1 << 62, 0, len(path)
            for length, s in self.states.out[state]:
                before = path[depth - length]
                s += score[before]
                if s > best:
                    best, count = s, tokens[before] + 1
        else:
            size = len(original.encode())
            best, count = score[node] + size * self.table.byte_score, tokens[node] + size
        self.child.append({})
        score.append(best)
        tokens.append(count)
        self.state.append(state)
        return len(score) - 1

    def count_rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, pre-tokens) of every row."""
        rows = len(off) - 1
        data, off = with_prefix(data, off)
        start, end, row = pretokens(data, off)
        if len(start) == 0:
            return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        if self.index.n + len(start) > self.index.limit:
            self.forget()
        if len(start) > self.index.limit:  # one very long text: it gets a table of its own size
            self.index = HashIndex(int(len(start)).bit_length() + 1)
        which, new = number_spans(self.index, data, start, end)
        if len(new):
            whole = data.tobytes()
            words = [whole[s:e] for s, e in zip(start[new].tolist(), end[new].tolist())]
            fresh = np.zeros(len(words), np.int64)
            for k in sorted(range(len(words)), key=words.__getitem__):  # in order, neighbours share prefixes
                fresh[k] = self.insert(*escape(words[k]))
            self.counts = np.r_[self.counts, fresh]
        n = np.bincount(row, weights=self.counts[which], minlength=rows)
        return n.astype(np.int64), np.bincount(row, minlength=rows).astype(np.int64)


#: One trie for each table, kept by a Python worker from task to task.
_TRIES: dict[int, CountTrie] = {}


def trie(table: PieceTable) -> CountTrie:
    if table.key not in _TRIES:
        _TRIES.clear()
        _TRIES[table.key] = CountTrie(table)
    return _TRIES[table.key]


FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_pretokens", T.LongType())])


def token_counts(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                 table: PieceTable | None = None) -> DataFrame:
    """Appends ``n_tokens`` and ``n_pretokens`` of every whole text."""
    shipped = df.sparkSession.sparkContext.broadcast(table or PieceTable.load())

    def make():
        counter = trie(shipped.value)

        def fn(texts: pa.Array) -> list[pa.Array]:
            parts = [counter.count_rows(data, off) for _, _, data, off, _ in tb.chunks(texts)]
            return [pa.array(np.concatenate(x)) for x in zip(*parts)]
        return fn

    return map_text(df, text_col, FIELDS, make, keep)
