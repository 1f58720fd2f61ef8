"""SentencePiece encoding and decoding by Aho-Corasick and Viterbi.

An Aho-Corasick automaton over all pieces reads a pre-token once.  Whenever it
reports a piece that ends at a position (its own node, then along the output
links), the best score of that position is relaxed with the best score where
the piece starts; so one pass gives the best segmentation of a unigram model.
A character that no one-character piece covers may always be written as its
UTF-8 bytes, at a score below every piece.  Among equal scores the longest
last piece wins.

Pre-tokens are independent (see ``pieces``): a task segments each distinct one
once, all new ones of a chunk in one pass over their concatenation, and finds
the others by hash.  Documents are rows
of an Arrow map: no shuffle.

Edge cases: null text gives null ids; empty text gives no ids; a literal
U+2581 is written as bytes, so decoding always gives back the text; very long
texts are handled whole (memory follows the longest one).
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textbytes as tb
from .pieces import HashIndex, PieceTable, escape, number_spans, pretokens, with_prefix
from .textmap import map_text

#: Stands between pre-tokens that are segmented in one pass; none but the line
#: break itself, whose ids are known from the start, holds it.
SEPARATOR = "\n"


class Encoder:
    """Segments whole rows; keeps the segmentations of up to a million
    distinct pre-tokens as flat arrays (about 40 MB), then starts anew."""

    def __init__(self, table: PieceTable):
        self.table = table
        self.auto = ahocorasick.Automaton()
        for p, (i, s) in table.pieces.items():
            self.auto.add_word(p, (len(p), i, s))
        self.auto.add_word(SEPARATOR, (1, -1, 0))
        self.auto.make_automaton()
        self.clear()

    def clear(self, bits: int = 21) -> None:
        self.index = HashIndex(bits)
        self.index.add(tb.hash_words([SEPARATOR]) | np.uint64(1))
        self.ids = np.array([self.table.byte_ids[ord(SEPARATOR)]], dtype=np.int32)
        self.length = np.ones(1, np.int64)
        self.start = np.zeros(1, np.int64)

    def viterbi(self, text: str) -> list[tuple[int, int]]:
        """Best segmentation of a text of covered characters as (end, id)."""
        best, back = [0] + [-1 << 62] * len(text), [None] * (len(text) + 1)
        for end, piece in self.auto.iter(text):
            end += 1
            s = best[end - piece[0]] + piece[2]
            if s > best[end]:
                best[end], back[end] = s, piece
        out, at = [], len(text)
        while at:
            length, i, _ = back[at]
            out.append((at, i))
            at -= length
        out.reverse()
        return out

    def segment(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each in characters) of pre-tokens with separators
        between them (id -1)."""
        text, original = escape(raw)
        ids, ends, at = [], [], 0
        for m in [*self.table.uncovered.finditer(text), None]:
            stop = m.start() if m else len(text)
            if stop > at:
                for e, i in self.viterbi(text[at:stop]):
                    ids.append(i)
                    ends.append(at + e)
            if m:
                for b in original[stop].encode():
                    ids.append(self.table.byte_ids[b])
                    ends.append(stop + 1)
                at = stop + 1
        return np.array(ids, dtype=np.int32), np.array(ends, dtype=np.int64)

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Segment new distinct pre-tokens, given by their spans."""
        size = end - start
        raw = data[tb.ragged(start, size)]
        after = np.cumsum(size)
        raw = np.insert(raw, after, ord(SEPARATOR))
        ids, ends = self.segment(raw.tobytes())
        chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][after + np.arange(len(after))]
        ends, ids = ends[ids >= 0], ids[ids >= 0]
        length = np.diff(np.r_[0, np.searchsorted(ends, chars, side="right")])
        last = np.cumsum(length)
        self.start = np.r_[self.start, len(self.ids) + last - length]
        self.length = np.r_[self.length, length]
        self.ids = np.r_[self.ids, ids]

    def encode_rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets per row) of whole rows."""
        data, off = with_prefix(data, off)
        start, end, row = pretokens(data, off)
        rows = len(off) - 1
        if len(start) == 0:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        if self.index.n + len(start) > self.index.limit:
            self.clear()
        if len(start) > self.index.limit:  # one very long text: it gets a table of its own size
            self.clear(int(len(start)).bit_length() + 1)
        which, new = number_spans(self.index, data, start, end)
        if len(new):
            self.learn(data, start[new], end[new])
        n = self.length[which]
        ids = self.ids[tb.ragged(self.start[which], n)]
        per_row = np.bincount(row, weights=n, minlength=rows).astype(np.int64)
        return ids, np.r_[0, np.cumsum(per_row)]


#: One encoder for each table, kept by a Python worker from task to task.
_ENCODERS: dict[int, Encoder] = {}


def encoder(table: PieceTable) -> Encoder:
    if table.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[table.key] = Encoder(table)
    return _ENCODERS[table.key]


class Decoder:
    """Bytes of id sequences."""

    def __init__(self, table: PieceTable):
        self.size = np.array([len(r) for r in table.raw], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(table.raw), dtype=np.uint8)

    def decode_rows(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, offsets) of the rows' texts, without the space that
        encoding has put in front."""
        size = self.size[ids]
        data = self.bytes[tb.ragged(self.start[ids], size)]
        ends = np.r_[0, np.cumsum(size)][off]
        full = np.diff(ends) > 0
        keep = np.ones(len(data), dtype=bool)
        keep[ends[:-1][full]] = False
        return data[keep], np.r_[0, np.cumsum(np.diff(ends) - full)]


ENCODED = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())),
                        T.StructField("n_tokens", T.LongType()),
                        T.StructField("round_trip", T.BooleanType())])


def _list_array(values: np.ndarray, off: np.ndarray, valid: np.ndarray) -> pa.Array:
    mask = None if valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values), mask=mask)


def encode(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
           table: PieceTable | None = None) -> DataFrame:
    """Appends ``token_ids``, ``n_tokens`` (0 for a null text) and
    ``round_trip`` (whether decoding gives back the very bytes)."""
    shipped = df.sparkSession.sparkContext.broadcast(table or PieceTable.load())

    def make():
        enc, dec = encoder(shipped.value), Decoder(shipped.value)

        def fn(texts: pa.Array) -> list[pa.Array]:
            lists, counts, trips = [], [], []
            for _, _, data, off, valid in tb.chunks(texts):
                ids, at = enc.encode_rows(data, off)
                back, back_off = dec.decode_rows(ids, at)
                lists.append(_list_array(ids, at, valid))
                counts.append(np.diff(at))
                trips.append(_equal_rows(data, off, back, back_off))
            return [pa.concat_arrays(lists), pa.array(np.concatenate(counts)), pa.array(np.concatenate(trips))]
        return fn

    return map_text(df, text_col, ENCODED, make, keep)


def decode(df: DataFrame, ids_col: str = "token_ids", out_col: str = "text", table: PieceTable | None = None) -> DataFrame:
    """The ids column turned back to text in ``out_col`` (null ids: null)."""
    shipped = df.sparkSession.sparkContext.broadcast(table or PieceTable.load())
    kept = [c for c in df.columns if c.lower() != out_col.lower()]
    at = kept.index(ids_col)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out_col, T.StringType())])

    def run(batches):
        dec = Decoder(shipped.value)
        for b in batches:
            lists = b.column(at)
            valid = np.asarray(lists.is_valid())
            lists = lists.fill_null([]) if lists.null_count else lists
            off = np.asarray(lists.offsets, dtype=np.int64)
            ids = np.asarray(lists.values)[off[0]:off[-1]]
            data, ends = dec.decode_rows(ids, off - off[0])
            whole = data.tobytes()
            texts = [whole[s:e].decode("utf-8", errors="replace") if ok else None
                     for s, e, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), valid.tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.select(*["`" + c.replace("`", "``") + "`" for c in kept]).mapInArrow(run, schema)


def _equal_rows(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
    if len(a) == len(b) and np.array_equal(a_off, b_off) and np.array_equal(a, b):
        return np.ones(len(a_off) - 1, dtype=bool)
    return np.array([np.array_equal(a[a_off[i]:a_off[i + 1]], b[b_off[i]:b_off[i + 1]]) for i in range(len(a_off) - 1)],
                    dtype=bool)
