"""Cleaning a corpus in stages; each takes what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.llm import bpe, decontamination, language, repeats, simhash
from folioguard.llm.common import set_aside
from folioguard.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

LEAST_LANGUAGE_SCORE = 0.3
SHINGLE_WORDS = 5
NEAR_BITS = 5
LEAST_SIMILARITY = 0.8
PASSAGE_WORDS = 51  # passages of over 50 words
PASSAGE_BYTES = 200  # and of at least so many bytes: shorter words than three letters on average are not looked for
CACHED_WORDS = 120_000  # workers share an executor's memory with what the earlier stages made it grow to


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network learned; those without a letter (null and empty texts too) or with a low score
    go. Repeated rows and null ids are judged like any other; other columns stay, whatever their names."""
    plain, restored = set_aside(docs, ("doc_id", "text", "lang"))
    named = language.identify(plain, keep=plain.columns)
    return restored(named.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of its five-word shingles, that with the
    smallest doc_id."""
    return simhash.first_of_similar(docs, SHINGLE_WORDS, NEAR_BITS, LEAST_SIMILARITY)


def strip_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``PASSAGE_WORDS`` words and over that are met elsewhere, the first time included. No
    document goes, though a text may be left empty.

    A null text stays null, an empty one empty; repeated rows are copies of one another and are emptied if they hold
    enough words. ``n_chars``, where there is one, follows the text. Other columns stay, whatever their names.
    """
    plain, restored = set_aside(docs)
    rows = plain.withColumn("__null", F.col("text").isNull())
    stripped = repeats.strip_repeats(
        rows, [c for c in rows.columns if c != "text"], PASSAGE_BYTES, as_text=True, least_words=PASSAGE_WORDS)
    out = restored(stripped.withColumn("text", F.when(~F.col("__null"), F.col("kept"))))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, parameters changed or not. Null and empty texts hold none and stay; repeated
    rows are judged like any other, and other columns stay, whatever their names."""
    plain, restored = set_aside(docs)
    return restored(decontamination.keep_clean(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), CACHED_WORDS)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("simhash", drop_near_duplicates),
    ("repeats", strip_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

# Language models, fingerprints and byte-pair merges are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
