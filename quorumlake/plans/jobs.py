"""Cancelling running searches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def job_group(spark: SparkSession, name: str) -> Iterator[str]:
    """Jobs started inside belong to ``name``; ``cancel`` ends them from another thread."""
    spark.addTag(name)
    try:
        yield name
    finally:
        spark.removeTag(name)


def cancel(spark: SparkSession, name: str) -> None:
    spark.interruptTag(name)
