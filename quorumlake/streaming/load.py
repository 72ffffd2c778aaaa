"""A closed-loop load client: so many callers, each sending its next batch when the last one is answered."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluate import by_instance, load_summary


@dataclass(frozen=True)
class Answer:
    """What a call returns: its status, and who answered."""

    status: int
    instance: str | None = None


def run_load(spark: SparkSession, call: Callable[[object], Answer], bodies: Sequence[object], callers: int = 4) -> tuple[DataFrame, float]:
    """Samples (latency_ms, status, instance), one for each of ``bodies``, and the seconds that all of them took.  A call that raises has status 0."""
    if callers <= 0:
        raise ValueError("the number of callers must be positive")

    def one(body: object) -> tuple[float, int, str | None]:
        began = time.perf_counter()
        try:
            answer = call(body)
        except Exception:  # noqa: BLE001 - a client counts whatever went wrong
            answer = Answer(0)
        return (time.perf_counter() - began) * 1000, answer.status, answer.instance

    began = time.perf_counter()
    with ThreadPoolExecutor(callers) as pool:
        rows = list(pool.map(one, bodies))
    return spark.createDataFrame(rows, "latency_ms double, status int, instance string"), time.perf_counter() - began


def summary(samples: DataFrame, seconds: float) -> tuple[DataFrame, DataFrame]:
    """Latencies and throughput, and answers by instance."""
    return load_summary(samples, seconds), by_instance(samples)
