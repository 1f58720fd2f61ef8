"""A training-text pipeline of five operators of ``salescope.llm``.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame; the stage's result is written as Parquet and
read again as the next one's ``docs``.  All stages but the last return the
columns of ``documents``.

1. toxicity: rejected documents go;
2. line_dedup: repeated lines go, with the documents of which nothing is left;
3. minhash: one document of each group of near copies stays (five words,
   similarity 0.8);
4. mixing: sources are brought to their target weights; a row is a document in
   one epoch of the mix, with the words taken in it;
5. sentencepiece: token ids of every row.

Null texts and empty tables pass through; see each operator for its cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salescope.llm import line_dedup, mixing, sentencepiece, superminhash, toxicity
from salescope.llm.sampling import remainder
from salescope.llm.tables import drop, materialize
from salescope.session import ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def _length(docs: DataFrame) -> str | None:
    return "n_chars" if "n_chars" in docs.columns else None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels, remainder("doc_id", 5) != 0))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return line_dedup.drop_lines(docs, length_col=_length(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return superminhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return mixing.mix_documents(docs, length_col=_length(docs))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return sentencepiece.encode(docs, keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

#: Learned weights and keyed permutations are not SQL; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    _ready(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(before)   # the written result of the stage before
    return docs
