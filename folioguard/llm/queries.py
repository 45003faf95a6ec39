"""The registered queries of this package, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.llm import (
    bpe, decontamination, language, lattice, pieces, quality, repeats, simhash, spelling, token_files, toxicity, tries, warc)
from folioguard.llm.common import fold, table
from folioguard.session import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_bpe_round_trip")
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_host_quality_rules", quality.ORACLE)
def op10_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_documents(table(spark, sf_dir, "documents"))
    return judged.drop("host", "host_rejected")


@query("op1_warc_salvage", warc.ORACLE)
def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"), staging_path(spark, "warc"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.file_round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), staging_path(spark, "tokens"))


@query("op8_simhash_components")
def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), shingle=3).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_language_network")
def op7_language_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, folds=5, held_out=0).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op5_prefix_doubling_dedup")
def op5_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = repeats.strip_repeats(table(spark, sf_dir, "documents"), passages=repeats.PASSAGE)
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                           "n_passages", "n_passage_bytes")


@query("op9_template_decontamination", decontamination.ORACLE)
def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op3_toxicity_sentences")
def op3_toxicity_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_lattice_likelihood")
def op6_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), folds=7, held_out=2)


@query("op11_spelling_variants", spelling.ORACLE)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


@query("op12_piece_round_trip")
def op12_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_conversation_trie", tries.ORACLE)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))
