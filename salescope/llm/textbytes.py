"""Text columns as flat UTF-8 arrays inside Arrow tasks.

Helpers for ``mapInArrow`` functions: they look at the bytes of a whole
string column at once, so that splitting, hashing and counting of words runs
in numpy without a Python object per word.  A batch is handled in chunks of
whole rows of about ``CHUNK_BYTES``; one longer text is a chunk by itself, so
memory is bounded by the chunk size or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTE = _table(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Powers of the base and of its inverse, grown when a longer chunk comes.
_POW = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of 256 entries, true in the given inclusive ranges."""
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo:hi + 1] = True
    return t


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing: digits, letters, all beyond ASCII)
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column; a null row has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    n = len(col)
    valid = np.ones(n, dtype=bool) if col.null_count == 0 else np.asarray(col.is_valid())
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    if col.null_count:
        col = col.fill_null("")
    bufs = col.buffers()
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(bufs[1], dtype=width)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0], valid


def chunks(col: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets, valid) of runs of whole rows."""
    limit = limit or CHUNK_BYTES
    data, off, valid = column_bytes(col)
    n, lo = len(valid), 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], valid[lo:hi]
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return _LOWER[data]


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of the class ``inside`` that stay in one row:
    (start, end, row) of each, in order."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    first = m.copy()
    first[1:] &= ~m[:-1] | edge[1:n]
    last = m.copy()
    last[:-1] &= ~m[1:] | edge[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of ``table[byte] * base ** position`` before each position."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands."""
    if len(start) == 0:
        return np.zeros(0, dtype=U64)
    p = prefix_hash(data)
    _, down = _powers(len(data) + 1)
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def hash_words(words: list[str]) -> np.ndarray:
    """``span_hash`` of single words given as text."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    end = np.cumsum([len(r) for r in raw]).astype(np.int64)
    start = end - np.array([len(r) for r in raw], dtype=np.int64)
    return span_hash(data, start, end)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``start[i] .. start[i] + length[i]``."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, length)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark longs."""
    return x.view(np.int64)


class SequenceHash:
    """Hashes of runs of consecutive items, given the items' own hashes."""

    def __init__(self, items: np.ndarray):
        self.up, self.down = _powers(len(items) + 2)
        self.sums = np.zeros(len(items) + 1, dtype=U64)
        np.cumsum(items * self.up[:len(items)], out=self.sums[1:])

    @staticmethod
    def _end(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix(h + n.astype(U64) * U64(0xA0761D6478BD642F))

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the items a .. b - 1, wherever they stand."""
        return self._end((self.sums[b] - self.sums[a]) * self.down[a], b - a)

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Hash of the items a .. b - 1 but the one at ``i``."""
        return self._end((self.sums[i] - self.sums[a]) * self.down[a]
                         + (self.sums[b] - self.sums[i + 1]) * self.down[a + 1], b - a - 1)
