"""Operators on pairs, groups and mixes: brute force and edge cases."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.llm import embedding_dedup, hilbert_search, line_dedup, mixing, superminhash
from salescope.llm.components import components


def groups(links, nodes):
    """Smallest node that links reach, for every node."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(501, 540)] + [(900, 901), (900, 901)]
    edges += [tuple(rng.sample(range(1000, 1100), 2)) for _ in range(70)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == groups(edges, {n for e in edges for n in e})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 5 MinHash ---------------------------------------------------------------

def variants(rng, base, n):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("pqrstuv") * 3
        out.append(" ".join(w))
    return out


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    both, one, two = (rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (800, 100, 100))
    a, b = np.unique(np.r_[both, one]), np.unique(np.r_[both, two])
    row = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    sig = superminhash.superminhash(row, np.r_[a, b], 3, 400)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.07
    assert np.isinf(sig[2]).all() and np.isfinite(sig[:2]).all()
    # every place of one element's signature comes from a different step
    single = superminhash.superminhash(np.zeros(1, int), a[:1], 1, 50)[0]
    assert sorted(np.floor(single).astype(int)) == list(range(50))


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates_brute_force(spark, shingle):
    rng = random.Random(shingle)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 60, 120]))]
        texts += variants(rng, base, rng.choice([1, 3, 25]))
    texts += [None, "", "  ", "one two", "One  two", "one two three", texts[0].upper(), texts[0], texts[3] + " tail"]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100)) + [(None, texts[0]), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    sets = {}
    for i, t in rows[:-2]:
        w = words(t)
        sets[i] = {tuple(w[k:k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    out = superminhash.near_duplicates(df, shingle=shingle).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["n_shingles"] == len(sets[r["doc_id"]])
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (want[r["doc_id"]] == r["doc_id"])
    one = superminhash.keep_one(df, shingle=shingle)
    assert one.columns == df.columns
    assert sorted(r["doc_id"] for r in one.collect() if r["doc_id"]) == sorted(i for i in want if want[i] == i)
    assert superminhash.near_duplicates(df.limit(0)).count() == 0


def test_a_bucket_of_strangers_loses_no_link(spark, monkeypatch):
    """All documents in one bucket: pivots alone would miss links among the rest."""
    monkeypatch.setattr(superminhash, "band_keys", lambda sig, bands, rows: np.zeros((len(sig), bands), np.uint64))
    rng = random.Random(9)
    texts = [t for _ in range(8) for t in variants(rng, ["v%d" % rng.randrange(900) for _ in range(80)], 4)]
    rng.shuffle(texts)
    sets = {i: {tuple(words(t)[k:k + 5]) for k in range(76)} for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(df).collect()}
    assert got == groups(links, sets)


def test_links_between_components_whatever_their_ids(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    for ids in ((-1, -2), (-1, -3), (5, 5 + (1 << 61) - 1), ("x", "y")):
        kind = "string" if isinstance(ids[0], str) else "long"
        rows = [(1, 0, 0, i, i, " ".join(base[:-1] + [str(k)])) for k, i in enumerate(ids)]
        rows.append((1, 0, 0, ids[0], ids[0], "something else"))
        groups = spark.createDataFrame(rows, f"k long, bi int, bj int, id {kind}, c {kind}, t string").coalesce(1)
        assert [tuple(r) for r in superminhash._between(groups, 4, 80).collect()] == [tuple(sorted(ids))]


def test_group_links_are_stars(spark):
    """A chain of components within one group: each reaches the least."""
    w = [f"w{i}" for i in range(400)]
    rows = [(1, 0, 0, 100 - i, 100 - i, " ".join(w[10 * i:10 * i + 100])) for i in range(20)]
    groups = spark.createDataFrame(rows, "k long, bi int, bj int, id long, c long, t string").coalesce(1)
    got = sorted(tuple(r) for r in superminhash._between(groups, 4, 80).collect())
    assert got == [(81, i) for i in range(82, 101)]


def test_near_copies_of_very_long_texts(spark):
    rng = random.Random(2)
    words_ = [f"w{rng.randrange(10 ** 6)}" for _ in range(200_000)]
    other = list(words_)
    for i in range(0, 200_000, 100):
        other[i] = "x"
    far = [f"v{rng.randrange(10 ** 6)}" for _ in range(200_000)]
    df = spark.createDataFrame([(-1, " ".join(words_)), (-2, " ".join(other)), (7, " ".join(far))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(df, shingle=4).collect()}
    assert got == {-1: -2, -2: -2, 7: 7}


# -- 6 embeddings ------------------------------------------------------------

def test_near_vectors_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 24))
    x = [c + rng.normal(size=24) * s for c in centres for s in [0.02, 0.05, 0.1, 0.2, 0.25] * 6]
    x += [x[0], x[0], x[0] * 2, rng.normal(size=24)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 24), (n + 2, [float("nan")] + [1.0] * 23), (n + 3, [None] + [1.0] * 23),
             (n + 4, [1.0, 2.0]), (n + 5, [float("inf")] * 24), (n + 6, []), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    m = np.array([r[1] for r in rows[:n]], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sure = m @ m.T
    links = [(a, b) for a, b in itertools.combinations(range(n), 2) if sure[a, b] >= 0.95]
    want = groups(links, range(n + 7))
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for block in (2_000, 4):  # 4: every bucket is cut into pairs of blocks
        found = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, block=block).collect()}
        assert len(found) == n + 8
        got = sum(r["n_links"] for r in found.values())
        assert 0.99 * 2 * len(links) <= got <= 2 * len(links)
        for i in range(n + 7):
            assert found[i]["n_links"] <= count[i]
            assert found[i]["component_id"] == want[i]
            assert found[i]["kept"] == (want[i] == i)
        assert found[None]["kept"] and found[None]["n_links"] == 0
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_unrelated_vectors_seldom_meet():
    """The rows that share a bucket follow the table's size."""
    rng = np.random.default_rng(8)
    for n in (500, 16_000, 50_000):
        x = rng.normal(size=(n, 64))
        shape = embedding_dedup.key_shape(n, 64)
        keys = np.concatenate([embedding_dedup.bucket_keys(x[lo:lo + 2_000], shape) for lo in range(0, n, 2_000)])
        _, size = np.unique(keys, return_counts=True)
        assert size[size > 1].sum() < 0.25 * keys.size
    for n in (500, 10_000, 10 ** 6, 10 ** 8):
        for dim in (64, 384):
            shape = embedding_dedup.key_shape(n, dim)
            axes = 2 * embedding_dedup.power_of_two(dim)
            assert axes ** (shape.hashes - 1) * 2 * shape.last_axes >= 16 * n * shape.probes


def test_vectors_at_the_least_cosine_meet():
    rng = np.random.default_rng(9)
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 3_000, 64)))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for n in (500, 10_000, 50_000, 10 ** 6, 10 ** 7):
        shape = embedding_dedup.key_shape(n, 64)
        a, b = (embedding_dedup.bucket_keys(v, shape) for v in (x, y))
        assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() >= 0.999


def _brute_links(x):
    m = np.array(x, dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.95
    np.fill_diagonal(linked, False)
    return linked


def test_small_groups_count_as_large_ones_do(monkeypatch):
    rng = np.random.default_rng(10)
    shape = embedding_dedup.key_shape(200, 24)
    size = np.array([2, 5, 2, 9, 2, 30])
    start, n = np.cumsum(size) - size, size.sum()
    x = rng.normal(size=(6, 24))[rng.integers(0, 6, n)] + rng.normal(size=(n, 24)) * 0.15
    side, weight = rng.integers(0, 2, n), rng.integers(1, 4, n)
    across = np.repeat([False, True, False, False, False, True], size)
    for key in (0, 1 << 62, 3 << 62, (1 << 64) - 1):
        key = np.full(n, key, np.uint64)
        got = [r.tolist() for r in embedding_dedup._small_groups(start, size, key, across, side, weight, x, shape, 0.95)]
        want = [[], [], []]
        for lo, s in zip(start, size):
            at = slice(lo, lo + s)
            own, links, low = embedding_dedup._group(key[lo], across[lo], side[at], weight[at], x[at], shape, 0.95)
            for w, g in zip(want, (own + lo, links, low + lo)):
                w += g.tolist()
        assert got == want
    # unrelated vectors: no bucket keys are made again
    monkeypatch.setattr(embedding_dedup, "bucket_keys", None)
    far = np.concatenate([np.eye(24)[:s] for s in size[:-1]])
    args = [v[:len(far)] for v in (key, across, side, weight)]
    assert [len(r) for r in embedding_dedup._small_groups(start[:-1], size[:-1], *args, far, shape, 0.95)] == [0, 0, 0]


def test_near_vectors_of_two_lengths_in_small_batches(spark):
    """A group that goes on in the next batch stays whole beside vectors of another length."""
    rng = np.random.default_rng(11)
    x = {d: [c + rng.normal(size=d) * 0.02 for c in rng.normal(size=(3, d)) for _ in range(20)] for d in (16, 24)}
    rows = [(2 * i + (d == 24), [float(v) for v in r]) for d in x for i, r in enumerate(x[d])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        found = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    finally:
        spark.conf.set(key, before)
    for d in x:
        for i, linked in enumerate(_brute_links(x[d])):
            own = found[2 * i + (d == 24)]
            assert own["n_links"] == linked.sum()
            assert own["component_id"] == 2 * (i - i % 20) + (d == 24)


# -- 7 mixing ----------------------------------------------------------------

def test_permutation_is_one():
    for n in (1, 2, 3, 10, 64, 1000, 4097):
        p = mixing.Permutation(n, 5, n)
        at = p(np.arange(n))
        assert sorted(at.tolist()) == list(range(n))
        assert p.inverse(at).tolist() == list(range(n))
    assert mixing.Permutation(1000, 1)(np.arange(9)).tolist() != mixing.Permutation(1000, 2)(np.arange(9)).tolist()


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_reaches_targets(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        s = rng.choice(["a"] * 12 + ["B", "é", "z", "tiny", None])
        n = rng.choice([0, 1, 5, 90, 400]) if s != "tiny" else (2 if i % 50 == 0 else 0)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(["w"] * n) if n or i % 2 else None, s))
    rows += [(None, "no id", "a"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    target = brute_targets(sizes)
    out = mixing.mix(df, block=16).collect()
    assert len(out) == len(rows)
    size_of = {i: (len(words(t)), s) for i, t, s in rows}
    taken = defaultdict(int)
    for r in out:
        n, s = size_of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s])
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * n
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    again = {tuple(r) for r in mixing.mix(df.repartition(7), block=16).collect()}
    assert again == {tuple(r) for r in out}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.choice([3, 40, 200]))), rng.choice("aaab"), 0, "x") for i in range(60)]
    rows.append((99, None, "a", 0, "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df, block=16).collect()}
    out = mixing.mix_documents(df, length_col="n_chars", block=16)
    assert out.columns == df.columns
    text, got = {r[0]: r[1] for r in rows}, defaultdict(int)
    for r in out.collect():
        own = r["text"].split()
        assert set(own) <= set(text[r["doc_id"]].split()) and len(set(own)) == len(own)
        assert r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += len(own)
    assert {i: n for i, n in taken.items() if n} == dict(got)
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_slots_of_an_epoch_are_distinct_blocks(spark):
    sources = spark.createDataFrame([(0, 10_000, 25_000.0), (1, 77, 10.4), (2, 0, 0.0)], "sid int, source_size long, target double")
    rows = mixing.slots(sources, block=16, run=100, shard_slots=300).collect()
    seen = [(r["sid"], r["epoch"], r["block"]) for r in rows]
    assert len(seen) == len(set(seen))
    assert sum(r["words"] for r in rows if r["sid"] == 0) == 25_000
    assert sum(r["words"] for r in rows if r["sid"] == 1) == 10
    per = defaultdict(int)
    for r in rows:
        per[r["shard"]] += 1
    assert len(per) == -(-len(rows) // 300) or len(per) == -(-len(rows) // 300) + 1
    assert max(per.values()) < 1.5 * min(per.values())


def test_shards_hold_what_they_draw(spark):
    rng = random.Random(16)
    rows = [(i, "w " * rng.choice([0, 3, 50, 200]), rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kw = dict(block=16, shard_slots=100)
    blocks = mixing.shard_blocks(df, **kw).collect()
    again = mixing.shard_blocks(df.repartition(5), **kw).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, again))
    # the shards hold the words that the mix takes, each in the shards it names
    words_of, shards_of = defaultdict(int), defaultdict(set)
    for r in blocks:
        words_of[r["id"]] += r["n"]
        shards_of[r["id"]].add(r["shard"])
    for r in mixing.mix(df, **kw).collect():
        own = shards_of[r["doc_id"]]
        assert r["taken"] == words_of[r["doc_id"]] and r["n_shards"] == len(own)
        assert r["first_shard"] == min(own, default=None)
    # a shard's counts by source are those of its blocks, and like a multinomial draw of the sources' totals
    source = {i: s for i, _, s in rows}
    want = defaultdict(lambda: [set(), 0])
    for r in blocks:
        cell = want[r["shard"], source[r["id"]]]
        cell[0].add((r["epoch"], r["slot"]))
        cell[1] += r["n"]
    got = {(r["shard"], r["source"]): (r["slots"], r["words"]) for r in mixing.shard_counts(df, **kw).collect()}
    assert got == {k: (len(a), n) for k, (a, n) in want.items()}
    shards = max(k[0] for k in got) + 1
    assert shards > 5
    for s in ("a", "b", None):
        counts = [got.get((k, s), (0, 0))[0] for k in range(shards)]
        mean = sum(counts) / shards
        spread = sum((c - mean) ** 2 for c in counts) / (shards - 1)
        assert 0.2 * mean < spread < 3 * mean  # Poisson-like: drawn, neither dealt evenly nor all in one


# -- 9 lines -----------------------------------------------------------------

def test_within_one_edit():
    a = "a b c d".split()
    for b, ok in (("a b c d", True), ("a b c", True), ("b c d", True), ("a x c d", True), ("a b c d e", True),
                  ("z a b c d", True), ("a c b d", False), ("a b", False), ("x b c y", False), ("", False)):
        assert line_dedup.within_one_edit(a, b.split()) == ok, b
        assert line_dedup.within_one_edit(b.split(), a) == ok, b
    assert line_dedup.within_one_edit(["a", "a"], ["a"])


def brute_lines(rows):
    lines = sorted((i is None, i if i is not None else 0, k, tuple(words(t))) for i, text in rows
                   for k, t in enumerate((text or "").split("\n")) if words(t))
    gone = {}
    for n, (no_id, i, k, w) in enumerate(lines):
        for no2, i2, k2, w2 in lines[:n]:
            same = w == w2
            near = min(len(w), len(w2)) >= 8 and line_dedup.within_one_edit(list(w), list(w2))
            if (same or near) and (no2, i2, k2) < (no_id, i, k):
                gone[(None if no_id else i, k)] = (i2, k2, 0 if same else 1)
                break
    return gone


def test_line_dedup_brute_force(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 30]))] for _ in range(25)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w[k:k + rng.randrange(2)] = rng.choice([["NEW"], [], [f"n{rng.randrange(3)}"]])
            text.append(rng.choice([" ", "  ", "\t"]).join(w).title())
        rows.append((i * 3 % 61, "\n".join(text)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, " ".join(base[-1]) + "\n" + " ".join(base[-1])), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_chars int, line string")
    want = brute_lines(rows)
    got = {(r["doc_id"], d["line"]): (d["of_id"], d["of_line"], d["edits"]) for r in line_dedup.line_report(df).collect()
           for d in r["dropped"]}
    assert set(got) == set(want)
    for key, (i, k, _) in want.items():
        assert got[key][:2] == (i, k), key
    out = line_dedup.drop_lines(df, length_col="n_chars")
    assert out.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in rows:
        own = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in want]
        if not any(key[0] == i for key in want):
            assert left[i] == t
        elif any(words(x) for x in own):
            assert left[i] == "\n".join(own)
        else:
            assert i not in left
    assert line_dedup.line_report(df.limit(0)).count() == 0


def test_short_lines_leave_as_exact_repeats(spark):
    rows = [(1, "Read more\nmenu\none two three\nx\n"), (2, "read  MORE\nown line"), (3, "menu"), (4, "read mores\nx y"),
            (None, "Menu\n\nlast")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    report = line_dedup.line_report(df).collect()
    got = {(r["doc_id"], d["line"]): (d["of_id"], d["of_line"], d["edits"]) for r in report for d in r["dropped"]}
    assert got == {(2, 0): (1, 0, 0), (3, 0): (1, 1, 0), (None, 0): (1, 1, 0)}
    assert {r["doc_id"]: r["n_lines"] for r in report} == {1: 4, 2: 2, 3: 1, 4: 2, None: 2}
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df).collect()}
    assert left == {1: rows[0][1], 2: "own line", 4: rows[3][1], None: "\nlast"}


# -- 10 search ---------------------------------------------------------------

def test_hilbert_is_a_walk_through_every_cell():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = hilbert_search.hilbert(cells, bits).astype(int)
        assert sorted(key.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_search_brute_force_and_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8)) * 3
    x = np.concatenate([c + rng.normal(size=(40, 8)) * 0.3 for c in centres]).astype(np.float32)
    x[1] = x[0]
    x[2] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5_000, None), (5_001, [0.0] * 8), (5_002, [float("nan")] * 8), (5_003, [1.0] * 7), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    m = x.astype(float)
    exact = {}
    for q in range(0, len(m), 20):
        s = (m[q] * m).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(m)), -s)) if i != q][:20]
        exact[q] = order
    # windows over the whole of one curve: exact
    got = defaultdict(list)
    for r in sorted(hilbert_search.search(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float((m[r["query_id"]] * m[r["vec_id"]]).sum()), abs=1e-12)
    assert set(got) == set(exact)
    assert all(got[q] == exact[q] for q in exact)
    # small blocks (here, too, windows would cover the table)
    near = hilbert_search.search(df, F.col("vec_id") % 20 == 0, block=32, recall=0.97).collect()
    found = defaultdict(set)
    for r in near:
        found[r["query_id"]].add(r["vec_id"])
    assert sum(len(found[q] & set(exact[q])) for q in exact) / sum(map(len, exact.values())) >= 0.9
    assert hilbert_search.search(df.limit(0), F.lit(True)).count() == 0
    few = hilbert_search.search(df.filter("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]


def test_narrow_windows_reach_the_recall(spark, monkeypatch):
    """A table of many blocks whose neighbours lie close on the curves: the
    windows run, not the whole of one curve."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 8)) * 4
    x = np.concatenate([c + rng.normal(size=(25, 8)) * 0.2 for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # the largest products are the nearest
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    seen = []
    window_for = hilbert_search.window_for

    def spied(index, *args):
        seen.append((window_for(index, *args), index.blocks))
        return seen[-1][0]
    monkeypatch.setattr(hilbert_search, "window_for", spied)
    found = defaultdict(dict)
    for r in hilbert_search.search(df, F.col("vec_id") % 20 == 0, block=16, recall=0.97).collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    (w, blocks), = seen
    assert blocks >= 150 and (2 * w + 1) * hilbert_search.CURVES < blocks
    hits = total = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -9
        best = np.argsort(-s)[:20].tolist()
        hits += len(set(best) & set(found[q]))
        total += 20
        assert all(abs(found[q][c] - s[c]) < 1e-12 for c in found[q])
    assert hits / total >= 0.9


def test_search_with_copies_and_several_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    x[7] = x[0] * 50  # nearest to row 0, and 40 times in the table
    y = rng.normal(size=(30, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 40 + [(100 + i, v.tolist()) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(hilbert_search.search(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    for m, at in ((x, 0), (y, 100)):
        for q in range(0, len(m), 20):
            order = [at + int(i) for i in np.argsort(-(m @ m[q]), kind="stable") if i != q][:20]
            assert got[at + q] == order
    assert set(got) == {0, 20, 40, 100, 120}
