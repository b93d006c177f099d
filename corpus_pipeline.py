"""From raw documents to a training mix, in five stages; each is written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents; the last returns them too, each document as often as the mix takes it.

In every stage rows that repeat id and text count as one document and a null id is an id of
its own, but for mixing, which deals rows one by one; columns beyond those of documents are
kept whatever their names, and an empty table stays empty. What becomes of null and empty
texts and of ties stands at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import covering_simhash, language_crf, suffix_decontam, systematic_mix, winnow_lines
from tidemark.llm.common import stored
from tidemark.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a clear language; those without letters (null and empty texts too) or without a clear language go; a score at the limit is clear enough."""
    return language_crf.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines and passages of 40 words that occur earlier are deleted; documents of which nothing is left stay, with an empty text.

    Null texts stay null. Of equal runs the first place stays, in order of id, then key, then line.
    """
    return winnow_lines.dedup(docs, words=winnow_lines.PASSAGE_WORDS)[0].select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, then the smallest key.

    Rows without a word (null and empty texts too) share fingerprint 0, so one of them stays.
    """
    return covering_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts have no words and stay."""
    return suffix_decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it.

    Null and empty texts have size 0 and are taken like others; a null source is a source of its own. Equal sizes are ordered by the digest of id and text.
    """
    return systematic_mix.emit(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing", mixing),
]

#: Language ID and SimHash can't be told in SQL; tests/llm/test_pipeline.py has a brute-force version of what follows from them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
