"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelwise.llm import (
    decontaminate, filter_audit, language_id, mixing, ngram_join, page_templates, pii, quality_qda, quality_trees, suffix_dedup,
    token_alignment, tool_calls, toxicity,
)
from parcelwise.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.document_languages(read(spark, folder, "documents")).drop("text_key")


def pages_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator where all kinds of evidence exist: on web pages."""
    return language_id.page_languages(read(spark, folder, "pages"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    chats = tool_calls.as_tool_chat(read(spark, folder, "conversations"))
    return tool_calls.formatted(chats, tool_calls.SEARCH)


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, folder, "documents"), width=4, percent=85)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return quality_trees.judge(docs, quality_trees.train(docs, read(spark, folder, "labels")))


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return quality_qda.classify(docs, quality_qda.train(docs, read(spark, folder, "labels")))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.passage_report(read(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return toxicity.classify(docs, toxicity.train(docs, read(spark, folder, "labels")))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(read(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.aligned(read(spark, folder, "documents"), groups=False)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op13_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return page_templates.extracted(read(spark, folder, "pages"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    return {
        "pipeline": pipeline,
        "op1_language_id": op1_language_id,
        "pages_language_id": pages_language_id,
        "op2_decontamination": op2_decontamination,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_quality_rules": op5_quality_rules,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_pii": op7_pii,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_mixing": op10_mixing,
        "op11_token_alignment": op11_token_alignment,
        "op12_filter_audit": op12_filter_audit,
        "op13_html_extraction": op13_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_formatting": tool_calls.ORACLE_SQL,
        "op4_ngram_jaccard_join": ngram_join.ORACLE_SQL,
        "op8_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op12_filter_audit": filter_audit.ORACLE_SQL,
    }
