"""What queries share with the cluster: the folder for intermediate tables, the package's path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one of our own only in local mode without it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quorumlake-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def fresh(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table; inside ``temporary`` it is deleted at the end."""
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are made inside go at the end, so results must be written by then."""
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            delete(spark, path)
        _made.reset(token)


def reach(spark: SparkSession) -> None:
    """Lets Python workers that see this folder import the package, wherever the driver was started.

    Executors that don't share the folder need the package by ``--py-files`` as usual.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
