"""Everything a scorer needs, loaded and checked before the first request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources import references
from .config import Config, load_config, setting
from .shared import fresh


@dataclass(frozen=True)
class Dataset:
    config: Config
    store: DataFrame


def load_dataset(spark: SparkSession, references_path: str, mcc_path: str, normalization_path: str, store_path: str | None = None) -> Dataset:
    """Configuration, then references: the first thing that is wrong ends the load, and no half-written store is returned."""
    config = load_config(mcc_path, normalization_path)
    path = store_path or fresh(spark, "store")
    checked = references.validate(references.read_references(spark, references_path))
    references.write_store(references.pack(checked), path)
    return Dataset(config, references.read_store(spark, path))


def load_from_environment(spark: SparkSession, folder: str = "resources") -> Dataset:
    """The same with paths from the environment."""
    at = lambda name, file: setting(name, f"{folder}/{file}")
    return load_dataset(spark, at("REFERENCES_PATH", "references.json.gz"), at("MCC_RISK_PATH", "mcc_risk.json"), at("NORMALIZATION_PATH", "normalization.json"))
