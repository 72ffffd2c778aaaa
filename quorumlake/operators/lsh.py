"""Approximate neighbours by locality-sensitive hashing, in stages.

A query reads the references of its own bucket in the first table, then in the second, then those of
all buckets at Hamming distance 1, 2, ... up to ``radius`` in either table, nearest buckets first.  It
stops before a stage once it has read ``enough`` references.  Queries that found fewer than k after all
of them read their coarse grid cell.  A reference that several stages find counts once.

``RADIUS`` without a stop is the setting of recall 0.9 and more (a test holds it against exact search);
``enough=k`` with ``radius=3`` is the frugal one, of low recall.  Buckets are never cut, so no candidate
is lost to a cap.

The index is stored in bucket order.  A block of queries is answered in two scans.  The first one reads the
buckets of equal signatures, met by their sorted values: it says which queries have found enough, and the
k-th key that they hold bounds the rest.  Without a stop, the second scan compares these queries with the
leaves of references within that bound (``leaves``) and leaves out what no bucket within the radius holds.
With a stop, they are done.  Queries that the first scan gave too few go through all stages, signature by signature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import BITS, SEEDS, coarse_cell, projection, signature
from ..functions.packing import COORDINATES
from ..plans.shared import fresh
from .blocks import PART, TILE, Best, check_k, collected_blocks, exact_keys, parts, top_k
from .leaves import GROUP, LEAF, grouped, near_pairs

#: Fixed value: references of a rank window.
CAP = 512
RADIUS = 2
TABLES = ("sig0", "sig1", "coarse")


def index(refs: DataFrame) -> DataFrame:
    """Adds sig0, sig1, coarse and projection to packed rows."""
    return refs.withColumns({"sig0": signature(SEEDS[0]), "sig1": signature(SEEDS[1]), "coarse": coarse_cell(), "projection": projection()})


def save_index(indexed: DataFrame, path: str, bucket: str = "sig0") -> None:
    """The index in (bucket, projection, id) order; lookups skip files and row groups by their statistics, and a large bucket may span files."""
    indexed.repartitionByRange(bucket, "projection").sortWithinPartitions(bucket, "projection", "ref_id").write.parquet(path)


def build(refs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored index of ``refs`` (ref_id, coordinates, fraud)."""
    spark = refs.sparkSession
    path = path or fresh(spark, "hashes")
    save_index(index(refs), path)
    return spark.read.parquet(path)


def bucket_ranks(indexed: DataFrame, bucket: str) -> DataFrame:
    """Adds the rank ``rk`` of each reference in its bucket by (projection, ref_id) and the bucket's size.

    Ranks are counted by ranges of the projection first, so that no task orders a whole large bucket.
    """
    part = F.floor(F.col("projection") / (1 << 14)).alias("part")
    sizes = indexed.groupBy(bucket, part).agg(F.count("*").alias("held"))
    inside = Window.partitionBy(bucket)
    before = F.coalesce(F.sum("held").over(inside.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(bucket).alias("b__"), F.col("part").alias("p__"), before.alias("before"), F.sum("held").over(inside).alias("bucket_n"))
    own = Window.partitionBy(bucket, "part").orderBy("projection", "ref_id")
    ranked = indexed.withColumn("part", part).withColumn("own", F.row_number().over(own))
    joined = ranked.join(starts, (F.col(bucket) == F.col("b__")) & (F.col("part") == F.col("p__")))
    return joined.withColumn("rk", (F.col("before") + F.col("own")).cast("int")).drop("b__", "p__", "before", "own", "part")


def candidate_counts(queries: DataFrame, refs: DataFrame, cap: int = CAP) -> DataFrame:
    """(query_id, candidates): references in the window of each query's own bucket of the first table."""
    if cap < 0:
        raise ValueError("the candidate limit must not be negative")
    sizes = index(refs).groupBy("sig0").agg(F.count("*").alias("n"))
    found = queries.select("query_id", signature(SEEDS[0]).alias("q_sig0")).join(sizes, F.col("q_sig0") == F.col("sig0"), "left")
    n = F.coalesce("n", F.lit(0))
    return found.select("query_id", (F.least(n, F.lit(cap)) if cap else n).alias("candidates"))


def window_of(probes: DataFrame, ranked: DataFrame, bucket: str, cap: int) -> DataFrame:
    """References in the window of ``cap`` ranks about each probe (query_id, ordinal, key, q_projection); 0 takes the whole bucket.

    A probe's place is the number of references of its bucket below its projection, by ranges first and
    in the order of references and probes together inside a range.  Windows meet references by blocks of
    ``cap`` ranks, two at most, so a large bucket gives a probe no more than 2 * ``cap`` rows to look at.
    """
    if cap == 0:
        return probes.join(ranked, F.col("key") == F.col(bucket))
    asked = probes.select("key").distinct()
    refs = ranked.select(F.col(bucket).alias("key"), F.col("projection").alias("at"), F.lit(1).alias("ref"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("int").alias("ordinal"))
    both = refs.join(asked, "key", "left_semi").unionByName(probes.select("key", F.col("q_projection").alias("at"), F.lit(0).alias("ref"), "query_id", F.col("ordinal").cast("int").alias("ordinal")))
    both = both.withColumn("part", F.floor(F.col("at") / (1 << 14)))
    inside = Window.partitionBy("key")
    held = both.groupBy("key", "part").agg(F.sum("ref").alias("held"))
    before = F.coalesce(F.sum("held").over(inside.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("key", "part", before.alias("before"), F.sum("held").over(inside).alias("n"))
    below = F.sum("ref").over(Window.partitionBy("key", "part").orderBy("at", "ref").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("below", below).where("ref = 0").join(held, ["key", "part"])
    low = F.greatest(F.lit(0), F.col("before") + F.col("below") - cap // 2)
    start = F.when(low + cap > F.col("n"), F.greatest(F.lit(0), F.col("n") - cap)).otherwise(low)
    block = lambda rank: F.floor((rank - 1) / cap).cast("int")
    spans = placed.select("query_id", "ordinal", "key", start.alias("start"), F.least(F.col("n"), low + cap).alias("end")).where("end > start")
    spans = spans.select("*", F.explode(F.sequence(block(F.col("start") + 1), block(F.col("end")))).alias("block"))
    joined = ranked.withColumn("block", block(F.col("rk"))).withColumn("key", F.col(bucket)).join(spans, ["key", "block"])
    return joined.where((F.col("rk") > F.col("start")) & (F.col("rk") <= F.col("end"))).drop("start", "end", "block")


def stages(radius: int) -> list[tuple[str, int]]:
    """(table, Hamming distance) in the order of reading; the coarse cell comes last."""
    if not 0 <= radius <= BITS:
        raise ValueError(f"the probe radius must be between 0 and {BITS}")
    return [(t, r) for r in range(radius + 1) for t in TABLES[:2]] + [("coarse", 0)]


def stage_of(asked: np.ndarray, held: np.ndarray, radius: int) -> np.ndarray:
    """For signatures (sig0, sig1, coarse) of queries and references, the first stage in which a pair meets; -1 for none."""
    last = 2 * (radius + 1)
    far = [np.bitwise_count(asked[:, t][:, None] ^ held[:, t][None, :]).astype(np.int16) for t in (0, 1)]
    first = np.minimum(*(np.where(h <= radius, 2 * h + t, last + 1) for t, h in enumerate(far)))
    first = np.where((first > last) & (asked[:, 2][:, None] == held[:, 2][None, :]), last, first)
    return np.where(first > last, -1, first)


def knn_lsh(queries: DataFrame, indexed: DataFrame, k: int, radius: int = RADIUS, enough: int | None = None, leave_self: bool = False) -> DataFrame:
    """The staged search on an index (``build`` or ``index``).  Queries that end with fewer than k neighbours keep what they have."""
    check_k(k)
    last = len(stages(radius)) - 1
    if enough is not None and enough < k:
        raise ValueError("a search can't stop before it has read k references")
    spark, path = queries.sparkSession, fresh(queries.sparkSession, "hashed")
    signed = queries.select("query_id", *COORDINATES).withColumns({"sig0": signature(SEEDS[0]), "sig1": signature(SEEDS[1]), "coarse": coarse_cell()})
    rows = indexed.select("ref_id", F.col("fraud").cast("int").alias("fraud"), *COORDINATES, *TABLES)
    for table in collected_blocks(signed):
        column = lambda c: table[c].to_numpy().astype(np.int64)  # noqa: B023, E731
        ids, q, asked = column("query_id"), np.stack([column(c) for c in COORDINATES], axis=1).astype(np.float64), np.stack([column(c) for c in TABLES], axis=1)

        def scan(task, some: np.ndarray, *more) -> DataFrame:
            """What ``task`` finds for the queries ``some``."""
            sent = spark.sparkContext.broadcast((ids[some], q[some], asked[some], *more))  # noqa: B023
            here = fresh(spark, "hashed-scan")
            rows.mapInArrow(task(sent, k, radius, enough, last, leave_self), SCHEMA).write.parquet(here)
            sent.destroy()
            return spark.read.schema(SCHEMA).parquet(here)

        equal = scan(_equal_task, np.arange(len(ids)))
        bound = _bounds(equal, ids, k, last, enough)
        done, left = np.flatnonzero(np.isfinite(bound)), np.flatnonzero(~np.isfinite(bound))
        found = []
        if len(done):
            names = spark.createDataFrame(pa.table({"query_id": np.unique(ids[done])}))
            # the bound counts rows of the first scan, so those at it are found again
            found.append(scan(_near_task, done, bound[done]) if enough is None else equal.join(names, "query_id", "left_semi"))
        if len(left):
            found.append(scan(_task, left))
        for part in found:
            _decided(part, k, last, enough).write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, ref_id long, distance_key long, fraud int").parquet(path)


SCHEMA = "query_id long, band int, ref_id long, distance_key long, fraud int, n long"


def _bounds(equal: DataFrame, ids: np.ndarray, k: int, last: int, enough: int | None) -> np.ndarray:
    """Of each query the k-th key of what the scan of equal signatures found; infinite if that was too little to stop."""
    best = _decided(equal, k, last, enough).groupBy("query_id").agg(F.max("distance_key").alias("key"), F.count("*").alias("held"))
    counts = equal.groupBy("query_id").agg(F.sum("n").alias("n"))
    # a query whose id several rows share is left to the scan of all stages
    known = best.join(counts, "query_id").where((F.col("held") == k) & (F.col("n") >= (enough or k))).select("query_id", "key").toArrow()
    key = dict(zip(known["query_id"].to_pylist(), known["key"].to_pylist(), strict=True))
    names, times = np.unique(ids, return_counts=True)
    single = set(names[times == 1].tolist())
    return np.array([key[i] if i in key and i in single else np.inf for i in ids.tolist()], np.float64)


def _columns(part: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    columns = [c.to_numpy(zero_copy_only=False) for c in part]
    return columns[0], columns[1].astype(np.int64), np.stack(columns[2:16], axis=1).astype(np.float64), np.stack(columns[16:], axis=1)


def _held(rows: int) -> int:
    return max(PART // rows, 1)


def _equal_task(sent, k: int, _radius: int, _enough: int | None, _last: int, leave_self: bool):
    """Stages 0 and 1: the references that share a query's bucket in the first table, then in the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, asked = sent.value
        best, count = {b: Best(len(qid), k) for b in (0, 1)}, {b: np.zeros(len(qid), np.int64) for b in (0, 1)}
        for part in parts(batches, _held(19)):
            ids, fraud, r, held = _columns(part)
            for t in (0, 1):
                mine, theirs = np.argsort(asked[:, t], kind="stable"), np.argsort(held[:, t], kind="stable")
                a, b = asked[mine, t], held[theirs, t]
                for value in np.intersect1d(a, b).tolist():
                    some = mine[np.searchsorted(a, value) : np.searchsorted(a, value, "right")]
                    those = theirs[np.searchsorted(b, value) : np.searchsorted(b, value, "right")]
                    for x in range(0, len(some), TILE):
                        rows = some[x : x + TILE]
                        for y in range(0, len(those), TILE):
                            cols = those[y : y + TILE]
                            keys = exact_keys(q[rows], r[cols])
                            if leave_self:
                                keys[qid[rows][:, None] == ids[cols][None, :]] = np.inf
                            if t:  # what the first table gave counts there
                                keys[asked[rows, 0][:, None] == held[cols, 0][None, :]] = np.inf
                            count[t][rows] += np.isfinite(keys).sum(axis=1)
                            best[t].add(rows, keys, ids[cols], fraud[cols])
        yield from _sent(qid, best, count)

    return run


def _near_task(sent, k: int, radius: int, _enough: int | None, _last: int, leave_self: bool):
    """All stages but the coarse one as one, for queries that have k references within a bound already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, asked, bound = sent.value
        best, groups = Best(len(qid), k), grouped(q, GROUP)
        best.key[:] = np.nextafter(bound, np.inf)[:, None]  # places that a reference at the bound still takes
        for part in parts(batches, _held(19)):
            ids, fraud, r, held = _columns(part)
            for some, those in near_pairs(groups, grouped(r, LEAF), ids, best):
                for a in range(0, len(some), TILE):
                    rows = some[a : a + TILE]
                    for b in range(0, len(those), TILE):
                        cols = those[b : b + TILE]
                        keys = exact_keys(q[rows], r[cols])
                        far = [np.bitwise_count(asked[rows, t][:, None] ^ held[cols, t][None, :]) for t in (0, 1)]
                        keys[np.minimum(*far) > radius] = np.inf
                        if leave_self:
                            keys[qid[rows][:, None] == ids[cols][None, :]] = np.inf
                        best.add(rows, keys, ids[cols], fraud[cols])
        best.key[best.id == np.iinfo(np.int64).max] = np.inf  # places that none took
        yield from _sent(qid, {0: best}, {0: np.isfinite(best.key).sum(axis=1)})

    return run


def _sent(qid: np.ndarray, best: dict[int, Best], count: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The best references of each stage, and a row for each query and stage with the number of references read."""
    for band in best:
        keep = np.isfinite(best[band].key)
        names = np.broadcast_to(qid[:, None], keep.shape)[keep]
        some = count[band] > 0
        none = [None] * int(some.sum())
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), band, np.int32)), pa.array(best[band].id[keep]), pa.array(best[band].key[keep].astype(np.int64)), pa.array(best[band].extra[keep].astype(np.int32)), pa.array([0] * len(names), pa.int64())], ["query_id", "band", "ref_id", "distance_key", "fraud", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(qid[some]), pa.array(np.full(len(none), band, np.int32)), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int32()), pa.array(count[band][some])], ["query_id", "band", "ref_id", "distance_key", "fraud", "n"])


def _task(sent, k: int, radius: int, enough: int | None, last: int, leave_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, asked = sent.value
        bands = range(last + 1) if enough is not None else (0, last)  # without a stop all but the last stage are one
        best, count = {b: Best(len(qid), k) for b in bands}, {b: np.zeros(len(qid), np.int64) for b in bands}
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for a in range(0, batch.num_rows, TILE):
                ids, fraud = columns[0][a : a + TILE], columns[1][a : a + TILE].astype(np.int64)
                r = np.stack([c[a : a + TILE] for c in columns[2:16]], axis=1).astype(np.float64)
                held = np.stack([c[a : a + TILE] for c in columns[16:]], axis=1)
                for b in range(0, len(qid), TILE):
                    rows = np.arange(b, min(b + TILE, len(qid)))
                    stage = stage_of(asked[rows], held, radius)
                    if leave_self:
                        stage[qid[rows][:, None] == ids[None, :]] = -1
                    if enough is None:
                        stage[(stage >= 0) & (stage < last)] = 0
                    keys = exact_keys(q[rows], r)
                    for band in np.unique(stage[stage >= 0]).tolist():
                        there = stage == band
                        count[band][rows] += there.sum(axis=1)
                        best[band].add(rows, np.where(there, keys, np.inf), ids, fraud)
        yield from _sent(qid, best, count)

    return run


def _decided(found: DataFrame, k: int, last: int, enough: int | None) -> DataFrame:
    """The k best of the stages that a query reads: each is read while the earlier ones held too few."""
    order = Window.partitionBy("query_id").orderBy("band").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    stop = F.when(F.col("band") == last, F.lit(k)).otherwise(F.lit(enough if enough is not None else 1))
    read = found.withColumn("before", before).where((F.col("before") < stop) & F.col("ref_id").isNotNull())
    return top_k(read, k).select("query_id", "rank", "ref_id", "distance_key", "fraud")
