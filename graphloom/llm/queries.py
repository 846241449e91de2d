"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import _sql, chat
from graphloom.llm._io import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secret_scan import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.embed_dedup import embedding_duplicates

    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.brown_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontam import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pii import pii_digests

    return pii_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_secret_scan, op2_chat_rotation, op3_embedding_dedup, op4_packing, op5_toxicity, op6_quality, op7_lm_scoring, op8_near_dedup, op9_decontamination, op10_pii]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": _sql.secrets_sql(),
        "op2_chat_rotation": chat.ORACLE,
        "op3_embedding_dedup": _sql.embedding_dedup_sql(),
        "op8_near_dedup": _sql.near_dedup_sql(),
        "op10_pii": _sql.pii_sql(),
    }
