"""Piece table of a public SentencePiece model, and the cutting of text into
pre-tokens, shared by encoding and token counting.

The table is read on the driver from a model file (a parameter) and shipped to
the tasks; its size is that of the vocabulary.  A piece's score is that of a
unigram model.  The file at hand holds merge ranks instead of probabilities
(its scores are 0, -1, -2, ...), so the default is a Zipf law over the file's
order, ``-log(rank + 1) - log(sum of 1/r)``; ``scores="model"`` takes the
file's own scores.  Scores are whole millionths, so sums are exact and a
segmentation never depends on what stands around a pre-token.

Text is escaped as SentencePiece does: one space is put in front, and spaces
count as part of the following word.  No piece has a space after another
character and none holds a line break (both are checked when the table is
read), so the best segmentation of a text is that of its pre-tokens: a run of
spaces with the non-space run behind it, cut before and after line breaks.
"""

from __future__ import annotations

import math
import os
import re

import numpy as np

from . import textbytes as tb

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands in the matched text where the original holds a literal U+2581, so
#: that only real spaces match pieces; no piece holds it.
LITERAL = "\x00"
UNKNOWN_PENALTY = 10.0
_NL = tb.byte_class((0x0A, 0x0A))
_SP = tb.byte_class((0x20, 0x20))


class PieceTable:
    """Pieces of the model: text -> (id, score), byte ids, and bytes per id."""

    def __init__(self, pieces: dict[str, tuple[int, int]], byte_ids: list[int], raw: list[bytes], byte_score: int):
        self.pieces, self.byte_ids, self.raw, self.byte_score = pieces, byte_ids, raw, byte_score
        covered = set("".join(pieces))
        self.single = {p for p in pieces if len(p) == 1}
        if covered - self.single:
            raise ValueError(f"characters without a piece of their own: {sorted(covered - self.single)[:5]}")
        #: a character outside every piece (the line break is the encoder's separator): it is written as bytes and cuts the text
        self.uncovered = re.compile("[^\n" + "".join(map(re.escape, sorted(covered))) + "]")
        #: tells tables apart in a task's caches
        self.key = hash(tuple(sorted(pieces.items())))

    @classmethod
    def load(cls, model_file: str | None = None, scores: str = "zipf") -> "PieceTable":
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=model_file or os.environ.get("SALESCOPE_PIECES", MODEL_FILE))
        normal, byte_ids, raw = [], [-1] * 256, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                normal.append((p, i, sp.get_score(i)))
                raw.append(p.replace(SPACE, " ").encode())
        return cls.of([(p, i, s if scores == "model" else None) for p, i, s in normal], byte_ids, raw)

    @classmethod
    def of(cls, normal: list[tuple[str, int, float | None]], byte_ids: list[int], raw: list[bytes]) -> "PieceTable":
        """From (piece, id, score); a score of None follows the Zipf law."""
        for p, _, _ in normal:
            if SPACE in p.lstrip(SPACE) or "\n" in p or LITERAL in p:
                raise ValueError(f"piece {p!r} crosses a pre-token")
        if min(byte_ids) < 0:
            raise ValueError("the model has no byte pieces")
        norm = math.log(sum(1.0 / r for r in range(1, len(normal) + 1)))
        table = {}
        for rank, (p, i, s) in enumerate(normal):
            table.setdefault(p, (i, round(1e6 * (-math.log(rank + 1) - norm if s is None else s))))
        lowest = min(s for _, s in table.values())
        return cls(table, byte_ids, raw, lowest - round(1e6 * UNKNOWN_PENALTY))


def escape(raw: bytes) -> tuple[str, str]:
    """(text for matching, original text) of a pre-token; equally long."""
    text = raw.decode("utf-8", errors="replace")
    return text.replace(SPACE, LITERAL).replace(" ", SPACE), text


def pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the pre-tokens of rows that already have their
    leading space; they cover every byte."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    nl, sp = _NL[data], _SP[data]
    first = nl.copy()
    first[1:] |= nl[:-1] | (sp[1:] & ~sp[:-1])
    first[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(first)
    return start, np.r_[start[1:], n], np.searchsorted(off, start, side="right") - 1


def with_prefix(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every non-empty row with one space in front."""
    size = np.diff(off)
    full = size > 0
    new_off = np.zeros(len(off), np.int64)
    np.cumsum(size + full, out=new_off[1:])
    out = np.full(new_off[-1], 0x20, np.uint8)
    if len(data):
        keep = np.ones(new_off[-1], dtype=bool)
        keep[new_off[:-1][full]] = False
        out[keep] = data
    return out, new_off


class HashIndex:
    """Numbers 64-bit hashes 0, 1, 2, ... in the order in which they are added;
    open addressing in flat arrays, for many lookups at once.  Holds up to
    ``limit`` hashes; the owner starts a new one when it is full."""

    def __init__(self, bits: int = 21):
        self.mask = (1 << bits) - 1
        self.limit = 1 << (bits - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.vals = np.zeros(1 << bits, dtype=np.int32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where it is new."""
        out = np.full(len(h), -1, dtype=np.int64)
        todo = np.arange(len(h))
        at = (h & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            k = self.keys[at]
            hit = k == h[todo]
            out[todo[hit]] = self.vals[at[hit]]
            go = ~hit & (k != 0)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out

    def add(self, h: np.ndarray) -> None:
        """New, distinct, non-zero hashes."""
        num = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        at = (h & np.uint64(self.mask)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]  # of several for one place the last stays
            won = self.keys[at] == h
            self.vals[at[won]] = num[won]
            h, num, at = h[~won], num[~won], (at[~won] + 1) & self.mask


def number_spans(index: HashIndex, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of every span in ``index``, one place of each new span in the
    order of the new numbers); new spans are added."""
    h = tb.span_hash(data, start, end) | np.uint64(1)
    which = index.find(h)
    new = np.flatnonzero(which < 0)
    if len(new) == 0:
        return which, new
    _, one, inv = np.unique(h[new], return_index=True, return_inverse=True)
    which[new] = index.n + inv.reshape(-1)
    index.add(h[new[one]])
    return which, new[one]
