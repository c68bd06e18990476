"""The corpus pipeline: five stages from raw documents to a weighted mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelwise.llm import decontaminate, language_id, mixing, ngram_join, pii
from parcelwise.llm.tables import kept, read

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; null and empty texts have none. Repeated rows are decided alike.

    Languages are learned from the rows that declare one; where none does, no language is known and all rows go.
    """
    return language_id.with_known_language(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows linked by near duplicates the one with the smallest id stays, of equal rows one.

    Decided by row, so a text is kept though its id is repeated with a copy. Null and empty texts and rows without an id stay.
    """
    return ngram_join.one_of_each_group(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay; repeated rows are decided alike."""
    return decontaminate.without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by labels; all rows stay, null and empty texts as they are."""
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the number of its words that the mix takes; null and empty texts have size 0 and give 0."""
    return mixing.mix(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("mixing", mixed),
]
# Language models, components and redaction are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
