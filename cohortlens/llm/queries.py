"""The registered queries of this package, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import sql
from cohortlens.llm.chat import chat_digest
from cohortlens.llm.common import table
from cohortlens.llm.decontamination import decontamination_digest
from cohortlens.llm.embedding_dedup import embedding_digest
from cohortlens.llm.language_model import language_model_digest
from cohortlens.llm.lexical_search import lexical_digest
from cohortlens.llm.licenses import license_digest
from cohortlens.llm.line_dedup import line_dedup_digest
from cohortlens.llm.mixing import mixing_digest
from cohortlens.llm.sharding import sharding_digest
from cohortlens.llm.simhash import simhash_digest
from cohortlens.llm.spelling import spelling_digest
from cohortlens.llm.suffix_dedup import suffix_dedup_digest
from cohortlens.llm.toxicity import toxicity_digest


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup_digest(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_digest(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding_digest(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_digest(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_digest(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_digest(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_digest(table(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digest(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_suffix_dedup,
        op3_embedding_dedup,
        op4_sharding,
        op5_licenses,
        op6_mixing,
        op7_language_model,
        op8_decontamination,
        op9_simhash,
        op10_line_dedup,
        op11_lexical_search,
        op12_spelling,
        op13_chat,
    )
}

SQL: dict[str, str] = {
    "op3_embedding_dedup": sql.EMBEDDING_DEDUP,
    "op6_mixing": sql.MIXING,
    "op8_decontamination": sql.DECONTAMINATION,
    "op10_line_dedup": sql.LINE_DEDUP,
    "op11_lexical_search": sql.LEXICAL_SEARCH,
    "op12_spelling": sql.SPELLING,
    "op13_chat": sql.CHAT,
}
