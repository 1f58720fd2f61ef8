"""The pipeline's stages against brute force on what each one is given."""

import itertools
from collections import defaultdict

import pytest

import corpus_pipeline
from salescope.llm import mixing, toxicity
from salescope.llm.sampling import remainder
from salescope.llm.tables import materialize
from test_llm_links import brute_lines, groups, words


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert dict(after.dtypes) == dict(before.dtypes), name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "mixing", "sentencepiece"]


def test_toxic_documents_go(spark, sf_dir, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(before, labels, remainder("doc_id", 5) != 0))
    want = {r["doc_id"] for r in toxicity.score(before, model).filter("score < 0.5").collect()}
    assert {i for i, _ in texts(after)} == want
    clean = {r["doc_id"] for r in labels.filter("toxic = 0").collect()} & {i for i, _ in texts(before)}
    assert len(clean & want) >= 0.97 * len(clean)


def test_repeated_lines_go(stages):
    before, after = stages["line_dedup"]
    rows = texts(before)
    gone = defaultdict(set)
    for i, k in brute_lines(rows):
        gone[i].add(k)
    want = {}
    for i, t in rows:
        if i not in gone:
            want[i] = t
        else:
            left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
            if words(left):
                want[i] = left
    assert dict(texts(after)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["doc_id"] in gone)


def test_one_of_each_group_stays(stages):
    before, after = stages["minhash"]
    sets = {}
    for i, t in texts(before):
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = {i for i, top in groups(links, sets).items() if i == top}
    assert sorted(texts(after)) == sorted((i, t) for i, t in texts(before) if i in want)


def test_sources_reach_their_targets(stages):
    before, after = stages["mixing"]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect()}
    got = defaultdict(int)
    for i, t in texts(after):
        got[i] += len(words(t))
    assert dict(got) == {i: n for i, n in taken.items() if n}
    sizes, total = defaultdict(int), defaultdict(int)
    for r in mixing.mix(before).join(before.select("doc_id", "source"), "doc_id").collect():
        sizes[r["source"]] = r["target"]
        total[r["source"]] += r["taken"]
    for s, target in sizes.items():
        assert abs(total[s] - target) <= 1


def test_ids_decode_to_the_texts(stages):
    before, after = stages["sentencepiece"]
    assert after.count() == before.count()
    assert after.filter("not round_trip or n_tokens <> size(token_ids)").count() == 0


def test_run_returns_the_last_stage(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    want = stages["sentencepiece"][1]
    assert got.columns == want.columns
    key = lambda r: (r["doc_id"], r["token_ids"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_odd_tables(spark, sf_dir):
    """Nulls, empty and repeated rows, extra columns; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, n string"
    rows = [(1, None, None, None, None, "a", "b", "c"), (2, "", "en", "x", 0, None, None, None),
            (3, "one two three four five six seven eight nine", "en", None, 9, "", "", ""),
            (3, "one two three four five six seven eight nine", "en", None, 9, "", "", ""),
            (None, "some words without an id stand here", None, "x", None, None, None, None),
            (4, "tie " * 3_000, "en", "x", 1, "s", "z", "n")]
    full = spark.createDataFrame(rows, schema)
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = materialize(stage(spark, docs, sf_dir), "test-odd")
            if name != "sentencepiece":
                assert after.columns == docs.columns, name
            if docs.count() == 0:
                assert after.count() == 0
            elif name in ("toxicity", "minhash"):
                assert after.count() == docs.count(), name
            docs = after
