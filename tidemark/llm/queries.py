"""The registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import (
    chunk_dedup, contract_sql, covering_simhash, language_crf, line_frequency, merkle_manifest, print_exchange, quote_links, secret_index, suffix_decontam, suffix_dedup, systematic_mix,
    turn_alignment, winnow_lines,
)
from tidemark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each document."""
    return language_crf.language_table(table(spark, folder, "documents"))


def op2_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each document without stretches of chunks that occur earlier."""
    return chunk_dedup.dedup_table(table(spark, folder, "documents"))


def op3_secret_index(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in each document."""
    return secret_index.secret_table(table(spark, folder, "documents"))


def op4_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of the quality rules for each document."""
    return line_frequency.quality(table(spark, folder, "documents"))


def op5_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    """All messages without quotes, in reply order."""
    return quote_links.reply_ordered(table(spark, folder, "conversations"))


def op6_systematic_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    return systematic_mix.mix_table(table(spark, folder, "documents"))


def op7_suffix_decontam(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that benchmark items hit, and the verdict."""
    found = suffix_decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of each document that a string repeated elsewhere covers, and a digest of the rest."""
    return suffix_dedup.dedup_table(table(spark, folder, "documents"))


def op9_covering_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of each document."""
    return covering_simhash.group_table(table(spark, folder, "documents"))


def op10_winnow_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each document without runs of lines that occur earlier."""
    return winnow_lines.dedup_table(table(spark, folder, "documents"))


def op10_winnow_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Each document without runs of lines that occur earlier, and without passages of 40 words in fewer lines."""
    return winnow_lines.dedup_table(table(spark, folder, "documents"), words=winnow_lines.PASSAGE_WORDS)


def op11_turn_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    return turn_alignment.repair_table(table(spark, folder, "conversations"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and checked proof of every document."""
    return merkle_manifest.manifest_table(table(spark, folder, "documents"))


def op13_print_exchange(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one that stays of its equals."""
    return print_exchange.dedup_table(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The stages of the corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_language_crf, op2_chunk_dedup, op3_secret_index, op4_line_frequency, op5_quote_links, op6_systematic_mix, op7_suffix_decontam, op8_suffix_dedup, op9_covering_simhash, op10_winnow_lines, op10_winnow_passages,
              op11_turn_alignment, op12_merkle_manifest, op13_print_exchange, pipeline)
}
ORACLES: dict[str, str] = {
    "op5_quote_links": quote_links.LINK_SQL, "op6_systematic_mix": systematic_mix.MIX_SQL, "op7_suffix_decontam": suffix_decontam.DECONTAM_SQL, "op10_winnow_lines": winnow_lines.WINNOW_SQL,
    "op10_winnow_passages": winnow_lines.PASSAGE_SQL, "op11_turn_alignment": contract_sql.REPAIR_SQL, "op12_merkle_manifest": contract_sql.MANIFEST_SQL,
    "op13_print_exchange": contract_sql.EXACT_SQL,
}
