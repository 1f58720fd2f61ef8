"""Per-document operators: brute force, exact round trips, held-out accuracy
and edge cases."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salescope.llm import langid, license_scan, sentencepiece, textbytes, token_counts, toxicity
from salescope.llm.pieces import SPACE, PieceTable
from salescope.llm.sampling import remainder

EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "ÄÖ ß\n\ndie Straße"), (6, "x" * 70_000), (7, "tie tie tie"),
        (7, "tie tie tie"), (None, "no id here"), (8, "lower ▁ bar \x00\x01 €😀 \r\n end  "), (9, "word " * 30_000)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn(
        "n_tokens", F.lit("own"))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# -- helpers -----------------------------------------------------------------

def test_spans_and_hashes():
    data, off, valid = textbytes.column_bytes(pa.array(["ab c", None, "", "c ab"]))
    s, e, row = textbytes.spans(data, off, textbytes.NOT_SPACE)
    assert row.tolist() == [0, 0, 3, 3] and valid.tolist() == [True, False, True, True]
    h = textbytes.span_hash(data, s, e)
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
    assert h[0] == textbytes.hash_words(["ab"])[0]


def test_chunks_cover_every_row():
    col = pa.array(["x" * n for n in (5, 0, 50, 3, 1, 0)] + [None])
    got = [(lo, hi, data.tobytes()) for lo, hi, data, _, _ in textbytes.chunks(col, 10)]
    assert [g[0] for g in got][0] == 0 and got[-1][1] == len(col)
    assert b"".join(g[2] for g in got) == b"x" * 59


# -- 1 license scan ----------------------------------------------------------

def brute_license(text):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(t)
    base = []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        base += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    score = 1.0 if base else 0.0
    labels = {label for _, label in base}
    for line in t.split("\n"):
        w = word.findall(line)
        starts = [0] if len(w) <= 64 else range(0, -(-(len(w) - 64) // 32) * 32 + 1, 32)
        for s in starts:
            for text_, label in license_scan.TEMPLATES:
                own = set(text_.split())
                common = len(own & set(w[s:s + 64]))
                if common >= np.ceil(0.8 * len(own) - 1e-9):
                    labels.add(label)
                    score = max(score, common / len(own))
    return len(words), sorted(base), labels, score


def test_license_lines_brute_force(spark):
    rng = random.Random(3)
    pool = sorted({w for t, _ in license_scan.TEMPLATES for w in t.split()}) + ["alpha", "beta", "née", "x9"]
    rows = [(i, t) for i, t in enumerate(
        [None, "", "Under the MIT  license, under-the MIT/license", "cc by-nc\ncc by\nnc", "Apache License, Version 2.0"]
        + [" ".join(rng.choice(pool) + rng.choice(["", ",", "\n", "."]) for _ in range(rng.choice([5, 30, 200])))
           for _ in range(60)]
        + ["zz " * 50 + "licensed under the apache licence version 2 0 " + "yy " * 70])]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id int, text string"), across_lines=False).collect()
    for r in got:
        n, base, labels, score = brute_license(r["text"])
        assert r["n_words"] == n
        assert sorted((b["word"], b["label"]) for b in r["base"]) == base
        assert {m["label"] for m in r["matches"]} | {b["label"] for b in r["base"]} == labels
        assert r["score"] == pytest.approx(score)


def test_license_notices_across_lines(spark):
    rng = random.Random(4)
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    pool = sorted({w for t, _ in license_scan.TEMPLATES for w in t.split()}) + ["alpha", "beta", "née", "x9"]
    texts = ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided",
             "This work is licensed under the GNU General\nPublic License version 3", "plain text", None, "",
             "zz " * 90 + " yy yy\nyy yy ".join("licensed under the mozilla public license version 2 0".split()) + " zz" * 90]
    texts += [" ".join(rng.choice(pool if rng.random() < 0.3 else ["q", "r"]) + rng.choice(["", "\n"]) for _ in range(n))
              for n in (5, 30, 64, 65, 300) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(2)
    got = {r["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    for i, text in enumerate(texts):
        words, want = word.findall((text or "").lower()), {}
        for s in range(len(words)):
            for k, (template, _) in enumerate(license_scan.TEMPLATES):
                own = set(template.split())
                common = len(own & set(words[s:s + 64]))
                if common >= np.ceil(0.8 * len(own) - 1e-9):
                    want[k] = max(want.get(k, 0), common / len(own))
        best = {}
        for m in got[i]["matches"]:
            own = set(license_scan.TEMPLATES[m["template"]][0].split())
            assert len(own & set(words[m["word"]:m["word"] + 64])) / len(own) == pytest.approx(m["containment"])
            best[m["template"]] = max(best.get(m["template"], 0), m["containment"])
        assert best == pytest.approx(want), text
    labels = [{m["label"] for m in got[i]["matches"]} for i in (0, 1, 2, 5)]
    assert labels[0] == {"bsd"} and labels[1] == {"gpl-3"} and labels[2] == set() and "mpl-2" in labels[3]


# -- 2 SentencePiece, 3 token counts ----------------------------------------

def small_table():
    pieces = [SPACE, "a", "b", "c", "ab", "bc", "abc", SPACE + "a", SPACE + "ab", "cab", SPACE * 2]
    normal = [(p, i, -1.0 - (i * 37 % 11) * 0.3) for i, p in enumerate(pieces)]
    n = len(pieces)
    return PieceTable.of(normal, list(range(n, n + 256)),
                         [p.replace(SPACE, " ").encode() for p in pieces] + [bytes([i]) for i in range(256)])


def best_score(table, text):
    """Largest score over all segmentations of the whole escaped text."""
    best = [0] + [None] * len(text)
    for e in range(1, len(text) + 1):
        options = [best[s] + table.pieces[text[s:e]][1] for s in range(e) if text[s:e] in table.pieces]
        if text[e - 1] not in table.single:
            options.append(best[e - 1] + len(text[e - 1].encode()) * table.byte_score)
        best[e] = max(options)
    return best[-1]


def test_encoding_is_the_best_segmentation():
    table = small_table()
    rng = random.Random(5)
    texts = ["".join(rng.choice("aabbcc  \nxé") for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    data, off, _ = textbytes.column_bytes(pa.array(texts))
    ids, at = sentencepiece.Encoder(table).encode_rows(data, off)
    n, _ = token_counts.CountTrie(table).count_rows(data, off)
    score_of = {i: s for i, s in table.pieces.values()}
    for k, t in enumerate(texts):
        own = ids[at[k]:at[k + 1]].tolist()
        assert sum(score_of.get(i, table.byte_score) for i in own) == best_score(table, " ".join(["", t]).replace(" ", SPACE))
        assert n[k] == len(own)
    back, back_off = sentencepiece.Decoder(table).decode_rows(ids, at)
    assert back.tobytes() == data.tobytes() and back_off.tolist() == off.tolist()


def test_round_trip_and_counts_on_whole_texts(spark, docs, edge):
    for df in (docs.select("doc_id", "text"), edge.select("doc_id", "text")):
        enc = sentencepiece.encode(df)
        assert enc.filter(~F.col("round_trip")).count() == 0
        back = sentencepiece.decode(enc.withColumnRenamed("text", "was"), out_col="now")
        assert back.filter(~F.col("was").eqNullSafe(F.col("now"))).count() == 0
        lens = sorted((r["text"] or "", r["n_tokens"]) for r in enc.collect())
        counts = sorted((r["text"] or "", r["n_tokens"]) for r in token_counts.token_counts(df).collect())
        assert lens == counts


def test_token_counts_survive_a_full_trie(monkeypatch):
    table = small_table()
    data, off, _ = textbytes.column_bytes(pa.array(["abc ab cab bca", "aab b cc", "abcabcabc"]))
    want = token_counts.CountTrie(table).count_rows(data, off)[0].tolist()
    monkeypatch.setattr(token_counts, "MAX_NODES", 3)
    assert token_counts.CountTrie(table).count_rows(data, off)[0].tolist() == want


def test_hash_index_numbers_everything_once():
    from salescope.llm.pieces import HashIndex
    x = HashIndex(8)
    h = textbytes.mix(np.arange(1, 101, dtype=np.uint64)) | np.uint64(1)
    x.add(h[:60])
    assert x.find(h).tolist() == [*range(60), *[-1] * 40]
    x.add(h[60:])
    assert x.find(h).tolist() == list(range(100))


# -- 4 toxicity --------------------------------------------------------------

def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_automaton_finds_what_edit_distance_finds():
    entries = ["loser", "scum", "lowei*", "idiot"]
    auto = toxicity.LexiconAutomaton(entries)
    rng = random.Random(2)
    words = [e.rstrip("*") for e in entries] + ["loweischaft", "lowi", "looser", "lose", "idoit", "scumm", "xscum", "loweixyz", "lwei"]
    for _ in range(400):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.randrange(2)] = [rng.choice("loseridtxwcum")] * rng.randrange(2)
        words.append("".join(w) or "q")
    data, off, _ = textbytes.column_bytes(pa.array(words))
    hit, entry, dist = auto.run(data, off[:-1], off[1:])
    got = dict(zip(hit.tolist(), zip(entry.tolist(), dist.tolist())))
    for k, w in enumerate(words):
        options = []
        for i, e in enumerate(entries):
            bare, limit = e.rstrip("*"), 1 if len(e.rstrip("*")) >= 5 else 0
            d = min(edits(bare, w[:n]) for n in range(len(w) + 1)) if e.endswith("*") else edits(bare, w)
            if d <= limit:
                options.append(d)
        assert (k in got) == bool(options), w
        if options:
            assert got[k][1] == min(options), w


def test_large_lexicons_are_not_made_whole():
    """5,000 entries over 3,000 letters; states come with the words that are read."""
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    entries = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([2, 2, 3, 4, 5, 6]))) for _ in range(5000)})
    began = time.monotonic()
    auto = toxicity.LexiconAutomaton(entries)
    assert time.monotonic() - began < 10
    long = [e for e in entries if len(e) >= 5][:40]
    short = [e for e in entries if len(e) < 5][:40]
    words = long + short + [e[:2] + e[3:] for e in long] + [e[:-1] + "x" for e in short] + ["plain"]
    data, off, _ = textbytes.column_bytes(pa.array(words))
    hit, entry, dist = auto.run(data, off[:-1], off[1:])
    got = {words[k]: (entries[e], d) for k, e, d in zip(hit.tolist(), entry.tolist(), dist.tolist())}
    want = {e: (e, 0) for e in long + short} | {e[:2] + e[3:]: (e, 1) for e in long}
    assert {w: got.get(w) for w in want} == want and not {e[:-1] + "x" for e in short} & set(got)
    assert len(auto.states) < 1500 and time.monotonic() - began < 20


def test_states_start_anew(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 3)
    auto = toxicity.LexiconAutomaton(["idiot", "scum"])
    data, off, _ = textbytes.column_bytes(pa.array(["idiot", "idot", "scum", "scu", "xyz"]))
    for _ in range(3):
        hit, _, dist = auto.run(data, off[:-1], off[1:])
        assert hit.tolist() == [0, 1, 2] and dist.tolist() == [0, 1, 0]


def brute_evidence(text, entries, weight):
    """Best window, all weights and distinct entries of a text, word by word."""
    hits = []
    number = 0
    for line in text.split("\n"):
        for m in re.finditer(r'[0-9a-z]+|"', line.lower()):
            if m.group() == '"':
                continue
            inside = line[:m.start()].count('"') % 2
            found = [(d, k) for k, e in enumerate(entries) if (d := edits(e, m.group())) <= (len(e) >= 5)]
            if found:
                d, k = min(found)
                if weight[k, d, inside] > 0:
                    hits.append((number, k, weight[k, d, inside]))
            number += 1
    best = max((sum(w for n2, _, w in hits if n <= n2 < n + toxicity.WINDOW) for n, _, _ in hits), default=0.0)
    return [best, sum(w for _, _, w in hits), len({k for _, k, _ in hits})]


def test_windows_and_scores_brute_force(spark):
    rng = random.Random(21)
    entries = ["fool", "idiot", "moron"]
    weight = np.array([[[1.0, 0.5], [0.0, 0.0]], [[2.0, 0.25], [1.5, 0.125]], [[1.25, 0.0], [0.75, 0.0]]])
    pool = ["fool", "idiot", "idot", "moron", "mopon", "idiots", '"', "\n"] + ["calm"] * 25
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([1, 10, 60, 200]))) for _ in range(80)]
    model = toxicity.ToxicityModel(entries, weight, np.array([-2.0, 1.0, 0.5, 0.25]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    for i, text in enumerate(texts):
        x = np.array(brute_evidence(text, entries, weight))
        assert got[i]["window_score"] == pytest.approx(x[0]), text
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-(np.r_[1.0, np.log1p(x)] @ model.beta))))


def test_conflicting_labels_and_short_and_long_terms(spark):
    junk = "q" * 60
    rows = [(f"say xq now {i}", 1) for i in range(30)] + [(f"say {junk} now {i}", 1) for i in range(30)]
    rows += [(f"say kind now {i}", 0) for i in range(90)] + [("say xq now 1", 0), ("say xq now 2", 0)]
    models = [toxicity.fit(spark.createDataFrame(rows, "text string, y int").repartition(n)) for n in (1, 5)]
    assert models[0].entries == models[1].entries and "xq" in models[0].entries
    assert np.allclose(models[0].weight, models[1].weight) and np.allclose(models[0].beta, models[1].beta)
    test = spark.createDataFrame([("an xq here",), (f"a {junk} here",), ("kind",)], "text string")
    got = [r["score"] for r in toxicity.score(test, models[0]).collect()]
    assert min(got[:2]) > 0.5 > got[2]


def test_one_edit_is_one_letter():
    entries = ["idiot", "глупец", "дур", "größe*", "😀😀😀😀😀"]
    auto = toxicity.LexiconAutomaton(entries)
    words = ["idïot", "idiôt", "idi", "ïdïot", "глупец", "глупц", "глупецы", "гпупец", "глпц", "дур", "дур" + "а", "дар", "ду",
             "größenwahn", "grösenwahn", "grosenwahn", "😀😀😀😀", "😀😀x😀😀", "😀😀😀", "idi漢t", "plain"]
    for some in (words, ["idiot", "idot", "xx"]):
        data, off, _ = textbytes.column_bytes(pa.array(some))
        hit, entry, dist = auto.run(data, off[:-1], off[1:])
        got = {some[k]: (entries[e], d) for k, e, d in zip(hit.tolist(), entry.tolist(), dist.tolist())}
        want = {}
        for w in some:
            for e in entries:
                bare = e.rstrip("*")
                d = min(edits(bare, w[:n]) for n in range(len(w) + 1)) if e.endswith("*") else edits(bare, w)
                if d <= (len(bare) >= 5):
                    want[w] = (e, d)
        assert got == want
    scan = toxicity.Scanner(["idiot"])
    data, off, _ = textbytes.column_bytes(pa.array(["né – “you idïot” «x»", "ça idiot"]))
    row, number, _, dist, quoted = scan.hits(data, off)
    assert (row.tolist(), number.tolist(), dist.tolist(), quoted.tolist()) == ([0, 1], [2, 1], [1, 0], [True, False])


def test_quoted_hits():
    scan = toxicity.Scanner(["idiot"])
    data, off, _ = textbytes.column_bytes(pa.array(['He said "you idiot" and left idiot', "“an idiot” idiot\n\" \nidiot"]))
    *_, quoted = scan.hits(data, off)
    assert quoted.tolist() == [True, False, True, False, False]


def test_held_out_toxicity(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels, remainder("doc_id", 5) != 0))
    assert "idiot" in model.entries
    rows = (toxicity.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").filter(remainder("doc_id", 5) == 0)
            .select("score", "toxic").collect())
    right = sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in rows)
    assert right / len(rows) > 0.93


def test_toxicity_edges(spark, edge):
    none = toxicity.fit(spark.createDataFrame([], "text string, y int"))
    assert {r["score"] for r in toxicity.score(edge, none).collect()} == {0.0}
    train = spark.createDataFrame([("you idiot", 1)] * 3 + [(f"idiot fool {i}", 1) for i in range(20)]
                                  + [(f"kind word {i}", 0) for i in range(60)] + [(None, 1)], "text string, y int")
    model = toxicity.fit(train)
    out = toxicity.score(edge, model)
    assert out.columns.count("score") == 1 and out.count() == len(EDGE)
    clean = toxicity.keep_clean(edge, model)
    assert clean.columns == edge.columns and clean.count() == len(EDGE)
    bad = spark.createDataFrame([("an idiot here",), ("an idioot here",), ("a kind word",)], "text string")
    got = [r["score"] for r in toxicity.score(bad, model).collect()]
    assert got[0] > 0.5 > got[2] and got[1] > got[2]
    assert toxicity.score(edge.limit(0), model).count() == 0


def test_lexicon_has_no_fixed_size(spark):
    """90 terms, each in under 1.5 % of the toxic texts."""
    bad = ["".join("bcdfghjklm"[int(x)] + "aeiou"[(int(x) * 3 + i) % 5] for x in f"{i * 7919 % 1000:03d}") + "zq" for i in range(90)]
    assert len(set(bad)) == 90
    rows = [(f"you {w} text {i} {k}", 1) for i, w in enumerate(bad) for k in range(10)]
    rows += [(f"you kind text {i}", 0) for i in range(1_800)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, y int").repartition(4))
    data, off, _ = textbytes.column_bytes(pa.array(bad))
    row, _, _, dist, _ = model.scan.hits(data, off)
    assert sorted(row[dist == 0].tolist()) == list(range(90))
    test = spark.createDataFrame([(f"some {w} here",) for w in bad] + [("some kind here",)], "text string")
    got = [r["score"] for r in toxicity.score(test, model).collect()]
    assert min(got[:-1]) > 0.5 > got[-1]


# -- 8 language --------------------------------------------------------------

def test_bit_sliced_masks_equal_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(1, 10_000, 400)).astype(np.uint64) for _ in range(70)]  # two planes
    filters = langid.BitSlicedFilters([f"l{i}" for i in range(70)], sets)
    probe = rng.integers(1, 10_000, 3_000).astype(np.uint64)
    hits = filters.hits(probe, np.zeros(len(probe), np.int64), 1)[0]
    for i, s in enumerate(sets):
        real = np.isin(probe, s).sum()
        assert real <= hits[i] <= real + 3_000 * filters.false_rate[i] * 3 + 10


def test_held_out_language(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, remainder("doc_id", 4) != 2)
    rows = langid.identify(docs, model).filter(remainder("doc_id", 4) == 2).select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_language_edges(spark, docs, edge):
    model = langid.fit(docs, F.lit(True))
    got = {(r["doc_id"], (r["text"] or "")[:3]): r for r in langid.identify(edge, model).collect()}
    for key in ((1, ""), (2, ""), (3, " \t\n")):
        assert got[key]["lang_pred"] == "und" and got[key]["score"] == 0.0
    assert all(0.0 <= r["score"] <= 1.0 for r in got.values())
    other = spark.createDataFrame([("Привет мир",), ("123 456",)], "text string")
    pred = [r["lang_pred"] for r in langid.identify(other, model).collect()]
    assert pred[0] in model.langs and pred[1] == "und"
    empty = langid.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(edge, empty).collect()} == {"und"}


def test_extra_columns_and_empty_tables(spark, edge):
    assert sentencepiece.encode(edge).columns == ["doc_id", "text", "score", "token_ids", "n_tokens", "round_trip"]
    assert license_scan.license_scan(edge).columns == ["doc_id", "text", "n_tokens", "n_words", "base", "matches", "score"]
    for fn in (sentencepiece.encode, token_counts.token_counts, license_scan.license_scan):
        assert fn(edge.limit(0)).count() == 0
        assert fn(edge).count() == len(EDGE)
