"""Registered queries of the operators: each applies one to its whole table
with production parameters and derives the result columns from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _joined(labels) -> F.Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def _license(found: DataFrame) -> DataFrame:
    base, match = F.col("base.label"), F.col("matches.label")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        _joined(base).alias("base_labels"), _joined(F.concat(base, match)).alias("labels"), "score")


@query("op1_license_scan", sql.license_scan())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    from .license_scan import license_scan
    return _license(license_scan(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@query("op1_license_scan_across_lines", sql.license_scan())
def op1_license_scan_across_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same: the operator's windows cross line breaks by default."""
    return op1_license_scan(spark, sf_dir)


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    from .sentencepiece import encode
    return encode(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and pre-tokens of every document."""
    from .token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones outside the
    held-out fifth."""
    from . import toxicity
    from .sampling import remainder
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels, remainder("doc_id", 5) != 0))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "window_score", "hits")


@query("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in the mix of sources to target weights."""
    from .mixing import mix
    return mix(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out quarter."""
    from . import langid
    from .sampling import remainder
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder("doc_id", 4) != 2)
    return langid.identify(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_grams")


@query("op5_minhash", sql.MINHASH)
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents, on runs of four words."""
    from .superminhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def _listed(report: DataFrame) -> DataFrame:
    one = lambda x: F.concat_ws(":", x["line"], x["of_id"], x["of_line"], x["edits"])
    return report.select("doc_id", "n_lines", "n_dropped", F.array_join(F.transform("dropped", one), ",").alias("dropped"))


@query("op9_line_dedup", sql.LINE_DEDUP)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line of the table."""
    from .line_dedup import line_report
    return _listed(line_report(table(spark, sf_dir, "documents")))


@query("op9_line_dedup_every_line", sql.LINE_DEDUP)
def op9_line_dedup_every_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same: every line that has a word takes part by default."""
    return op9_line_dedup(spark, sf_dir)


@query("op6_embedding_dedup", sql.EMBEDDING_DEDUP)
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings."""
    from .embedding_dedup import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_nearest")
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest inner product for every twentieth embedding."""
    from .hilbert_search import search
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 tokens."""
    from .packing import pack
    pieces = pack(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op12_spelling", sql.SPELLING)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the words they are variants of."""
    from .spelling import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_vector_codes", sql.VECTOR_CODES)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings."""
    from .vector_codes import compress
    return compress(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
