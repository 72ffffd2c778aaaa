"""Corpus pipeline: quality rules, near-duplicates, decontamination, source mixing, sharding.

Every stage works on all that its predecessor kept and returns whole rows; the last adds ``shard``
and ``shard_bytes``.  Near-duplicates are texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more: SimHash candidates are verified, and an exact join finds what fingerprints miss.
The document of smallest id of each group stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorumlake.llm import decontam, mixing, overlap, quality, sharding
from quorumlake.llm.common import documents, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return overlap.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Components of near copies and exact binomial bounds have no practical SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs
