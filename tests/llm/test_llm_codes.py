"""Packing, spelling variants and product codes: brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from salescope.llm import packing, spelling, textbytes, vector_codes


# -- 11 packing ----------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_str(packing.tokenizer_json())


def test_ids_are_those_of_whole_texts(tokenizer):
    rng = random.Random(7)
    symbols = list("abcdeABZ  '''!?.,<|>0129\n\t\r\x0b\x1c\x85\x00") + [
        "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "é", "́", "̸", " ", "　", "İ",
        "Σ", "ς", "漢字", "<", "=", "ﬁ", "ǅ", "😀", "‍", "½", "٣"]
    texts = ["".join(rng.choice(symbols) for _ in range(rng.randrange(0, 60))) for _ in range(2000)] + ["a" * 3000, "x'" * 900]
    data, off, _ = textbytes.column_bytes(pa.array(texts))
    ids, ends = packing.Tokens(packing.tokenizer_json()).rows(data, off)
    for i, text in enumerate(texts):
        assert ids[ends[i]:ends[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1], text


def test_differencing_deals_all_and_evenly():
    rng = random.Random(2)
    for k in (1, 2, 5, 16):
        sizes = [rng.randrange(1, 2048) for _ in range(12 * k)]
        sets = packing.differencing(sizes, k)
        assert sorted(i for s in sets for i in s) == list(range(len(sizes))) and len(sets) == k
        sums = [sum(sizes[i] for i in s) for s in sets]
        # far nearer to each other than dealing the items around
        around = [sum(sizes[i::k]) for i in range(k)]
        assert max(sums) - min(sums) <= max(2048 // 8, 1) and max(sums) - min(sums) <= max(around) - min(around)
    # two sets: the differences of the largest pairs, worked out by hand (8-7, 6-5, 4-1 ...)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert packing.differencing([], 3) == [[], [], []]


@pytest.mark.parametrize("cut", [True, False])
def test_divide_keeps_to_the_capacity(cut):
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 40))]
        windows = packing.divide(sizes, 64, cut)
        assert max(sum(n for _, _, n in w) for w in windows) <= 64
        pieces = sorted(p for w in windows for p in w)
        covered = defaultdict(int)
        for i, s, n in pieces:
            assert n > 0 and s == covered[i]
            covered[i] += n
        assert [covered[i] for i in range(len(sizes))] == sizes
        if cut:
            assert len(windows) == math.ceil(sum(sizes) / 64)
        else:
            assert all(s == 0 for _, s, _ in pieces)
    # three items of two thirds: two windows are beyond the capacity, the count rises to three
    assert len(packing.divide([40, 40, 40], 64, cut=False)) == 3


def check_pieces(rows, texts, tokenizer, capacity, cut=True):
    """Every id in one piece, sequences gapless; returns sequence lengths."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, text in texts:
        want = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        got = sorted(by_doc[i], key=lambda r: r["start"])
        at = 0
        for r in got:
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want)
            assert bytes(r["ids"]) == want[at:at + r["length"]].tobytes()
            at += r["length"]
        assert at == len(want)
    sizes = []
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        sizes.append(at)
    return sizes


@pytest.mark.parametrize("partitions", [1, 3])
def test_pack_brute_force(spark, tokenizer, partitions):
    rng = random.Random(partitions)
    texts = [(i, " ".join(rng.choice(["cat", "dog's", "Über", "42", "x;y"]) for _ in range(rng.choice([1, 5, 40, 300]))))
             for i in range(150)]
    texts += [(900, None), (901, ""), (902, "word " * 5000), (903, " \n ")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(partitions)
    pieces = packing.pack(df, keep=["doc_id"], capacity=128, group=4)
    sizes = check_pieces(pieces.collect(), texts, tokenizer, 128)
    assert all(n == 128 or n & (n - 1) == 0 for n in sizes)  # no padding at all
    whole = packing.sequences(pieces, 128).collect()
    assert sorted(r["n_tokens"] for r in whole) == sorted(sizes) and sum(r["padding"] for r in whole) == 0
    assert all(len(r["ids"]) == 4 * r["n_tokens"] == 4 * sum(r["lengths"]) for r in whole)


def test_pack_whole_pieces(spark, tokenizer):
    rng = random.Random(8)
    texts = [(i, "cat " * rng.randrange(0, 200)) for i in range(120)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), keep=["doc_id"],
                        capacity=128, group=8, cut=False).collect()
    sizes = check_pieces(rows, texts, tokenizer, 128, cut=False)
    assert all(r["start"] % 128 == 0 for r in rows)  # only whole windows are cut off
    assert 128 * len(sizes) < 1.25 * sum(sizes)


def test_pack_edge_cases(spark, tokenizer):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0
    # repeated rows, a null id, columns named like the appended ones (in other case too)
    df = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, "c", None, None)],
                               "doc_id long, text string, Start int, extra string")
    out = packing.pack(df)
    assert out.columns == ["doc_id", "text", "extra", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = out.collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in rows if r["start"] == 0) == [(0, 2), (1, 3), (1, 3)]
    numbers = packing.pack(spark.createDataFrame([(1, 17)], "doc_id long, text int"), keep=[]).collect()
    assert sum(r["length"] for r in numbers) == 3  # two digits and the end


# -- 12 spelling ---------------------------------------------------------------

def brute_spelling(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return brute_variants({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def brute_variants(words):
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    by_gap = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_gap[w[:i], w[i + 1:]].add(w)
    for group in by_gap.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = {}
    for _ in range(60):
        base = "".join(rng.choice("abcé") for _ in range(rng.choice([5, 5, 6, 7, 9, 14, 30])))
        for _ in range(rng.randrange(1, 25)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
                i = rng.randrange(len(w) + 1)
                op = rng.randrange(3)
                w[i:i + (op > 0)] = [] if op == 1 else [rng.choice("abcéz")]
            if len(w) >= 5:
                words["".join(w)] = rng.choice([3, 4, 6, 8, 16, 33, 100])
    words |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48, "baaaa": 6, "abababab": 5, "babababa": 9}
    words |= {"long" * 900: 3, "long" * 899 + "lon": 7, "long" * 450 + "x" + "long" * 450: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    want = brute_variants(words)
    for frequent in (1, 30, 10 ** 9):  # no gram grows, some do, all do
        monkeypatch.setattr(spelling, "FREQUENT", frequent)
        assert result(spelling.variants(df)) == want


def test_near_words_share_all_grams_but_one():
    rng = random.Random(6)
    tried = 0
    while tried < 300:
        word = "".join(rng.choice("ab") for _ in range(rng.randrange(5, 12)))
        chars = list(word)
        i, op = rng.randrange(len(word)), rng.randrange(3)
        chars[i:i + (op > 0)] = [] if op == 1 else ["c"]
        other = "".join(chars)
        if min(len(word), len(other)) < 5:
            continue
        tried += 1
        code = lambda g: int.from_bytes(g.encode(), "big")
        frequent = {2: np.array([code("ab"), code("ba"), code("bc")])}
        flat = spelling.Flat(pa.array([word, other]))
        w, at, length = flat.decompose(frequent)
        for k, text in enumerate((word, other)):
            cut = [(text + "$")[p - flat.start[k]:p - flat.start[k] + n] for p, n in zip(at[w == k], length[w == k])]
            assert "".join(cut) == text + "$" and all(len(g) >= 2 for g in cut[:-1])
            assert all((len(g) == 3) == (g[:2] in ("ab", "ba", "bc")) for g in cut[:-1])
        # one of the two finds the other under its own grams' keys
        def listed(k):
            out = set()
            for by in range(spelling.MAX_GRAM):
                on = (w == k) & (length + by <= spelling.MAX_GRAM + 1) & (at + length + by <= flat.end[k])
                n = (length + by)[on]
                out |= set(flat.keys(w[on], at[on], n, flat.size[w[on]], n).tolist())
            return out

        def sought(k, by):
            on = (w == k) & (length + by > 0)
            return set(flat.keys(w[on], at[on], length[on], flat.size[w[on]] + by, (length + by)[on]).tolist())
        by = len(other) - len(word)
        assert sought(0, by) & listed(1) or sought(1, -by) & listed(0)


def test_tables_as_long_as_the_words_are_never_broadcast(spark, monkeypatch):
    # their files are far below the threshold here, as compressed words are where their gram rows fill a driver
    plans = {}
    def spied(df, name, files=None):
        plans.setdefault(name, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return materialize(df, name, files)

    materialize = spelling.materialize
    monkeypatch.setattr(spelling, "materialize", spied)
    counts = [("sample", 50), ("samples", 20), ("sampel", 3), ("simples", 4), ("a" * 70, 9), ("a" * 69 + "b", 3), ("other", 5)]
    out = spelling.variants(spark.createDataFrame(counts, "word string, n long"))
    plans["out"] = [out._jdf.queryExecution().sparkPlan().toString()]
    assert {r["word"]: r["root"] for r in out.collect()} == {
        "sample": "sample", "samples": "sample", "sampel": "sampel", "simples": "sample", "a" * 70: "a" * 70,
        "a" * 69 + "b": "a" * 70, "other": "other"}
    for name in ("near-words", "near-pairs", "word-forms", "roots", "out"):
        for plan in plans[name]:
            assert "Broadcast" not in plan, name
        assert "SortMergeJoin" in plans[name][-1], name


def test_word_counts_and_edge_cases(spark):
    rng = random.Random(5)
    vocabulary = ["Straße", "haUSse", "naïve", "naive", "colour", "color", "coloür", "x" * 70_000, "MÜLLER", "müller", "abc"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(60)]
    rows += [(1, "colour-colour_colour9colour"), (1, "colour-colour_colour9colour"), (70, None), (71, ""), (None, "colour color " * 3), (72, "1 2")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = result(spelling.spelling_variants(df))
    assert got == brute_spelling(rows) and any(r[1] for r in got)
    assert result(spelling.spelling_variants(df.limit(0))) == set()
    assert result(spelling.spelling_variants(spark.createDataFrame([(1, None)], "doc_id long, text string"))) == set()


# -- 13 product codes ----------------------------------------------------------

def brute_codes(rows, parts, entries, rounds, scale=256):
    """rows of (id, label, vector): {(id, code, error, label_error)}, sha256."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = max(1, -(-max(len(r[2]) for r in kept) // parts))
    whole = [[math.floor(scale * x) for x in r[2]] + [0] * (dim * parts - len(r[2])) for r in kept]
    cut = [[tuple(w[p * dim:(p + 1) * dim]) for p in range(parts)] for w in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(c)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    label = defaultdict(int)
    for r, f in zip(kept, found):
        label[r[1]] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = [(r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), label[r[1]]) for r, f in zip(kept, found)]
    return sorted(out, key=repr), digest


def codes(df, **kw):
    rows = vector_codes.compress(df, "vec_id", "embedding", "label", keep=["vec_id"], **kw).collect()
    digests = {r["codebooks_sha256"] for r in rows}
    assert len(digests) == 1
    return sorted([(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows], key=repr), digests.pop()


SCHEMA = "vec_id long, label string, embedding array<double>, code string"


@pytest.mark.parametrize("dims,parts,grid", [(8, 4, 3), (16, 4, 40), (6, 4, 5)])
def test_codes_brute_force(spark, monkeypatch, dims, parts, grid):
    monkeypatch.setattr(vector_codes, "BLOCK", 7)  # paths go on from block to block
    monkeypatch.setattr(vector_codes, "SLICE", 100)
    rng = random.Random(dims)
    rows = [(i, rng.choice(["a", "b", None]), [rng.randrange(-grid, grid) / 64 for _ in range(dims)]) for i in range(250)]
    rows += [(3, "a", rows[0][2]), (3, "a", rows[0][2]), (None, "b", rows[1][2])]
    rows += [(900, "a", None), (901, "a", [None] + rows[0][2][1:]), (902, "a", [float("nan")] * dims), (903, "a", [float("inf")] * dims)]
    rows += [(904, "c", [0.0] * dims), (905, "c", []), (906, "c", [0.5])]
    rng.shuffle(rows)
    for partitions in (1, 4):
        df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(partitions)
        assert codes(df, parts=parts, entries=20) == brute_codes(rows, parts, 20, 2)


def test_nearest_equals_all_distances():
    rng = np.random.default_rng(1)
    for block in (1, 3, 4096):
        vector_codes.BLOCK, before = block, vector_codes.BLOCK
        try:
            for dtype in (np.int64, object):
                part, book = rng.integers(-4, 4, (200, 4)).astype(dtype), rng.integers(-4, 4, (9, 4)).astype(dtype)
                leaves, leaf, times = vector_codes.distinct(part)
                entry, distance = vector_codes.nearest(leaves, book)
                every = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
                assert (entry[leaf] == every.argmin(axis=1)).all() and (distance[leaf] == every.min(axis=1)).all()
                assert times.sum() == 200 and len({tuple(x) for x in leaves.tolist()}) == len(leaves)
        finally:
            vector_codes.BLOCK = before


def test_codes_of_huge_components(spark):
    rng = random.Random(9)
    rows = [(i, "a" if i % 2 else "b", [rng.choice([1e3, -2.5e6, 3e6, 0.25]) + i for _ in range(4)]) for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    assert codes(df, parts=2, entries=4) == brute_codes(rows, 2, 4, 2)
    rows.append((50, "b", [1e30, -1e30, 0.0, 1e300]))  # its entry moves; its error may be beyond a long
    got, digest = codes(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), parts=2, entries=4)
    want, want_digest = brute_codes(rows, 2, 4, 2)
    fits = lambda v: v if v < 1 << 63 else None
    assert digest == want_digest and got == sorted([(i, c, fits(e), fits(s)) for i, c, e, s in want], key=repr)


def test_codes_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([(1, "a", None, "x")], SCHEMA)
    for df in (empty, none):
        out = vector_codes.compress(df)
        assert out.columns == ["vec_id", "label", "embedding", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    one = vector_codes.compress(spark.createDataFrame([(1, None, [0.5] * 16, "x")], SCHEMA)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00" * 16, 0, 0)]
    floats = spark.createDataFrame([(1, "a", [0.1] * 32), (2, "a", [0.2] * 32)], "vec_id long, label string, embedding array<float>")
    assert [r["error"] for r in vector_codes.compress(floats).collect()] == [0, 0]
    assert vector_codes.compress(floats.withColumn("label", F.lit(None).cast("int"))).filter("label_error = 0").count() == 2
