"""Exact k nearest neighbours.

Rows are (id, coordinates...); the distance key is the integer sum of squared differences and ties
go to the smaller reference id.  ``knn_arrow``, ``knn_arrays`` and ``knn_float`` are the block search
of ``blocks`` over packed columns, arrays of any dimension and doubles.  ``knn_sql`` says the same in
DataFrame terms over leaves and serves as the cross-check.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import from_key, squared
from ..functions.packing import COORDINATES
from ..plans.shared import fresh
from .blocks import PART, check_k, parts, query_blocks, search, top_k
from .leaves import LEAF, grouped

#: The nearest leaf in each of so many parts of the leaves bounds the k-th key of a query in ``knn_sql``.
BOUND_PART = 4
FLOATS = tuple(f"v{i}" for i in range(14))


def paired(refs: DataFrame, queries: DataFrame) -> DataFrame:
    """Every reference with every row of ``queries`` (query_id, ...): broadcasts of one block each, at any size."""
    return reduce(DataFrame.unionByName, [refs.crossJoin(F.broadcast(part)) for part in query_blocks(queries)])


def squared_to(prefix: str) -> Column:
    return squared((F.col(prefix + c), F.col(c)) for c in COORDINATES)


def knn_sql(queries: DataFrame, refs: DataFrame, k: int, leave_self: bool = False) -> DataFrame:
    """``queries`` (query_id, coordinates) against ``refs`` (ref_id, coordinates, fraud): (query_id, rank, ref_id, distance_key, fraud).

    Every query meets every leaf's box; it is compared with the references of those leaves only that are within a bound on its k-th key.
    """
    check_k(k)
    spark = refs.sparkSession
    asked = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in COORDINATES])
    leaved = _leaved(refs)
    path = fresh(spark, "asked")
    asked.join(_bounds(asked, leaved, k, leave_self), "query_id", "left").write.parquet(path)
    bound = F.col("bound")
    reached = paired(_boxes(leaved), spark.read.parquet(path)).where(bound.isNull() | (_gap() <= bound)).select("leaf", "query_id", "bound", *[f"q_{c}" for c in COORDINATES])
    pairs = reached.join(leaved, "leaf")
    if leave_self:
        pairs = pairs.where("query_id <> ref_id")
    within = bound.isNull() | (squared_to("q_") <= bound)
    return top_k(pairs.where(within).select("query_id", "ref_id", "fraud", squared_to("q_").alias("distance_key")), k).select("query_id", "rank", "ref_id", "distance_key", "fraud")


def _leaved(refs: DataFrame) -> DataFrame:
    """``refs`` with ``leaf``, a group of near references of one task, as a table."""
    names, spark = ["ref_id", "fraud", *COORDINATES], refs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = TaskContext.get().partitionId() << 32
        for columns in parts(batches, PART // len(COORDINATES)):
            groups = grouped(np.stack([c.to_numpy().astype(np.float64) for c in columns[2:]], axis=1), LEAF)
            of = leaf + np.repeat(np.arange(len(groups.low)), np.diff(groups.first))
            leaf += len(groups.low)
            table = pa.Table.from_arrays([*(c.take(pa.array(groups.order)) for c in columns), pa.array(of)], names=[*names, "leaf"])
            yield from table.to_batches(max_chunksize=1 << 16)

    path, rows = fresh(spark, "leaves"), refs.select(*names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows.mapInArrow(run, f"{kinds}, leaf long").write.parquet(path)
    return spark.read.parquet(path)


def _boxes(leaved: DataFrame) -> DataFrame:
    """(leaf, low_*, high_*), a table."""
    path = fresh(leaved.sparkSession, "boxes")
    leaved.groupBy("leaf").agg(*[f(c).alias(f"{side}_{c}") for c in COORDINATES for side, f in (("low", F.min), ("high", F.max))]).write.parquet(path)
    return leaved.sparkSession.read.parquet(path)


def _gap() -> Column:
    """The least possible key of a query in a box."""
    return squared((F.greatest(F.col(f"low_{c}") - F.col(f"q_{c}"), F.col(f"q_{c}") - F.col(f"high_{c}"), F.lit(0)), F.lit(0)) for c in COORDINATES)


def _bounds(asked: DataFrame, refs: DataFrame, k: int, leave_self: bool) -> DataFrame:
    """(query_id, bound), a table: k references at least are no farther.  They are the nearest ones of k parts of the references of a few near leaves."""
    leaved = refs if "leaf" in refs.columns else _leaved(refs)
    some = paired(_boxes(leaved), asked).select("query_id", "leaf", _gap().alias("gap")).groupBy("query_id", F.pmod(F.xxhash64("leaf"), F.lit(BOUND_PART)).alias("of")).agg(F.min(F.struct("gap", "leaf")).alias("m"))
    pairs = some.select("query_id", F.col("m.leaf").alias("leaf")).join(asked, "query_id").join(leaved, "leaf")
    if leave_self:
        pairs = pairs.where("query_id <> ref_id")
    nearest = pairs.groupBy("query_id", F.pmod(F.xxhash64("ref_id"), F.lit(k)).alias("part")).agg(F.min(squared_to("q_")).alias("key"))
    path = fresh(refs.sparkSession, "bounds")
    nearest.groupBy("query_id").agg(F.max("key").alias("bound"), F.count("*").alias("parts")).where(F.col("parts") == k).select("query_id", "bound").write.parquet(path)
    return refs.sparkSession.read.parquet(path)


def knn_arrow(queries: DataFrame, refs: DataFrame, k: int, leave_self: bool = False) -> DataFrame:
    return search(queries, refs, k, COORDINATES, leave_self=leave_self)


def knn_first(queries: DataFrame, refs: DataFrame, leave_self: bool = False) -> DataFrame:
    """(query_id, ref_id, distance_key, tied): the nearest reference and the number of all references at its distance."""
    return search(queries, refs, 1, COORDINATES, leave_self=leave_self, first=True).select("query_id", "ref_id", "distance_key", "tied")


def knn_arrays(queries: DataFrame, refs: DataFrame, k: int, leave_self: bool = False) -> DataFrame:
    """The same for array columns ``coords`` of one dimension; ``label`` is kept."""
    return search(queries, refs, k, ("coords",), extra="label", nested=True, leave_self=leave_self)


def knn_float(queries: DataFrame, refs: DataFrame, k: int, leave_self: bool = False) -> DataFrame:
    """Unpacked vectors v0..v13 in doubles, summed in dimension order."""
    return search(queries, refs, k, FLOATS, exact=False, leave_self=leave_self)


def nearest(query: list[int], refs: DataFrame, k: int) -> DataFrame:
    """One query given as literals: a distributed ``TakeOrderedAndProject``, no join."""
    check_k(k)
    key = squared((F.lit(int(v)), F.col(c)) for v, c in zip(query, COORDINATES, strict=True))
    return refs.select("ref_id", "fraud", key.alias("distance_key")).orderBy("distance_key", "ref_id").limit(k)


def with_distance(neighbors: DataFrame) -> DataFrame:
    """Adds ``distance`` to the k results."""
    return neighbors.withColumn("distance", from_key(F.col("distance_key")))
