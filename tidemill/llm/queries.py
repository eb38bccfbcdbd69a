"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import chat, decontaminate, packing, pii, quality, simhash, substrings, templates, token_counts, urls
from tidemill.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(table(spark, sf_dir, "conversations")).withColumn("parts", chat.text_parts())
    return chat.digest_conversations(chat.format_turns(turns.drop("text")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=True)
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")  # a cut may halve a character


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))


OPERATORS = (
    op1_decontamination,
    op2_token_counts,
    op3_html_extraction,
    op4_chat_formatting,
    op5_simhash,
    op6_suffix_dedup,
    op7_quality_rules,
    op8_packing,
    op9_url_filters,
    op10_pii,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": chat.oracle(), "op9_url_filters": urls.oracle()}
