"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, mixing, pii, quality, sharding, simhash, substring, suffix, tokens
from .common import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path(vocabulary))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


_QUERIES = (
    op1_personal_data,
    op2_substring_dedup,
    op3_source_mixing,
    op4_simhash_near_dedup,
    op5_benchmark_decontamination,
    op6_token_counts,
    op7_suffix_array_dedup,
    op8_sharding,
    op9_quality_rules,
    op10_chat_formatting,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring.ORACLE_SQL,
        "op3_source_mixing": mixing.ORACLE_SQL,
        "op5_benchmark_decontamination": decontam.ORACLE_SQL,
        "op7_suffix_array_dedup": suffix.ORACLE_SQL,
        "op8_sharding": sharding.ORACLE_SQL,
        "op9_quality_rules": quality.oracle_sql(),
        "op10_chat_formatting": chat.ORACLE_SQL,
    }
