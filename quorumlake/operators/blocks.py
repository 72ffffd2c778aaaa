"""Block search: queries go to the references, which stay where they lie.

The queries are taken in blocks of at most ``QUERY_BLOCK``; a block is broadcast, each task scans its
references once in parts of about ``PART`` coordinates, compares queries with the leaves of near
references only (``leaves``), keeps the best k of every query in NumPy, and the shuffle carries k
rows a query and task.  A block's answers become a table and its broadcast is destroyed
before the next block is read, so neither the driver nor an executor holds more than one block,
however many queries there are.

Keys of integer coordinates are computed in doubles, exactly: all terms are integers below 2**53.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import fresh
from .leaves import GROUP, LEAF, grouped, near_pairs

QUERY_BLOCK = 20_000
#: Keys that are computed at once, queries and references of such a tile.
TILE = 2048
#: Coordinates of the references that a task holds at once.
PART = 1 << 23


def check_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def top_k(pairs: DataFrame, k: int, key: str = "distance_key") -> DataFrame:
    """The k best rows of each query by (key, ref_id), with ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(key, "ref_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The k best references of each query so far, by (key, id)."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.key = np.full((queries, k), np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.extra = np.zeros((queries, k), np.int64)

    @property
    def worst(self) -> np.ndarray:
        return self.key[:, -1]

    @property
    def worst_id(self) -> np.ndarray:
        return self.id[:, -1]

    def add(self, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, extra: np.ndarray) -> None:
        """Takes in ``keys`` of queries ``rows`` (distinct) with references ``ids``; infinite keys don't count."""
        near = (keys <= self.worst[rows][:, None]) & np.isfinite(keys)
        if keys.shape[1] > self.k and np.count_nonzero(near) > 4 * self.k * len(rows):  # most of them at first
            near &= keys <= np.partition(keys, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        r, c = np.nonzero(near)
        if not len(r):
            return
        touched, place = np.unique(r, return_inverse=True)
        old = rows[touched]
        n = len(touched)
        at = np.concatenate((np.repeat(np.arange(n), self.k), place))
        key = np.concatenate((self.key[old].ravel(), keys[r, c]))
        id_ = np.concatenate((self.id[old].ravel(), ids[c]))
        more = np.concatenate((self.extra[old].ravel(), extra[c]))
        order = np.lexsort((id_, key, at))
        first = np.searchsorted(at[order], np.arange(n))
        best = order[first[:, None] + np.arange(self.k)]
        self.key[old], self.id[old], self.extra[old] = key[best], id_[best], more[best]


class First:
    """The nearest reference of each query so far, by (key, id), and how many references have its key (``extra``)."""

    def __init__(self, queries: int):
        self.key = np.full((queries, 1), np.inf)
        self.id = np.full((queries, 1), np.iinfo(np.int64).max)
        self.extra = np.zeros((queries, 1), np.int64)

    @property
    def worst(self) -> np.ndarray:
        return self.key[:, 0]

    @property
    def worst_id(self) -> np.ndarray:  # ties count whatever their ids
        return np.full(len(self.key), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, _extra: np.ndarray) -> None:
        least = keys.min(axis=1)
        same = (keys == least[:, None]) & np.isfinite(least)[:, None]
        tied, id_ = same.sum(axis=1), np.where(same, ids[None, :], np.iinfo(np.int64).max).min(axis=1)
        less, equal = least < self.worst[rows], (least == self.worst[rows]) & np.isfinite(least)
        self.id[rows, 0] = np.where(less, id_, np.where(equal, np.minimum(self.id[rows, 0], id_), self.id[rows, 0]))
        self.extra[rows, 0] = np.where(less, tied, self.extra[rows, 0] + np.where(equal, tied, 0))
        self.key[rows, 0] = np.minimum(least, self.key[rows, 0])


def exact_keys(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Squared distances of integer coordinates by one matrix product."""
    return (q * q).sum(axis=1)[:, None] - 2 * (q @ r.T) + (r * r).sum(axis=1)[None, :]


def float_keys_within(q: np.ndarray, r: np.ndarray, k: int, worst: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Squared distances summed in the order of the dimensions, as any engine sums them, where they can be among the k least and within ``worst``, else infinite; pairs ``left`` don't count.

    One matrix product says which; its error is far below the slack.
    """
    norms = (q * q).sum(axis=1)[:, None] + (r * r).sum(axis=1)[None, :]
    slack, about = norms * 1e-12, norms - 2 * (q @ r.T)
    about[left] = np.inf
    within = about <= worst[:, None] + slack
    if len(r) > k:
        within &= about - slack <= np.partition(about + slack, k - 1, axis=1)[:, k - 1 : k]
    a, b = np.nonzero((within | np.isnan(about)) & ~left)
    keys, total = np.full(about.shape, np.inf), np.zeros(len(a))
    for d in range(q.shape[1]):
        gap = q[a, d] - r[b, d]
        total += gap * gap
    keys[a, b] = total
    return keys


#: (query rows, reference rows) of a batch to compare, given the batch's further columns and the best so far.
Chooser = Callable[[object, list[np.ndarray], np.ndarray, Best], Iterator[tuple[np.ndarray, np.ndarray]]]


def _vectors(columns: list[pa.Array], nested: bool) -> np.ndarray:
    if not nested:
        return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.float64)
    flat = columns[0].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(columns[0]), -1)


def query_blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """Disjoint parts of ``queries`` of about ``QUERY_BLOCK`` rows."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for i in range(blocks):
        yield queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)


def collected_blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """The blocks on the driver, one at a time.  The plan of ``queries`` runs once: more than a block are stored first."""
    few = queries.limit(QUERY_BLOCK + 1).toArrow()
    if few.num_rows <= QUERY_BLOCK:
        yield few
        return
    del few
    path = fresh(queries.sparkSession, "queries")
    queries.write.parquet(path)
    for part in query_blocks(queries.sparkSession.read.parquet(path)):
        yield part.toArrow()


def search(
    queries: DataFrame, refs: DataFrame, k: int, coordinates: tuple[str, ...], extra: str = "fraud", nested: bool = False, exact: bool = True,
    leave_self: bool = False, further: tuple[str, ...] = (), prepare: Callable[[np.ndarray, np.ndarray], object] = lambda ids, q: None, choose: Chooser | None = None, first: bool = False,
) -> DataFrame:
    """(query_id, rank, ref_id, distance_key, ``extra``) of ``queries`` (query_id, coordinates) and ``refs`` (ref_id, extra, coordinates, further).

    ``nested``: the one coordinate column is an array.  ``prepare`` makes, on the driver, what ``choose``
    needs to know of a block's queries; ``choose`` names the pairs of each batch that are compared, without it
    those within reach.  ``first``: the nearest one only, and ``extra`` is the number of references at its distance.
    """
    check_k(k)
    spark, kind = queries.sparkSession, "long" if exact else "double"
    path = fresh(spark, "neighbors")
    rows = refs.select("ref_id", F.col(extra).cast("long").alias("x"), *coordinates, *further)
    schema = f"query_id long, ref_id long, distance_key {kind}, x long"
    for block in collected_blocks(queries.select("query_id", *coordinates)):
        ids = block["query_id"].to_numpy().astype(np.int64)
        vectors = _vectors([block[c].combine_chunks() for c in coordinates], nested) if len(ids) else np.empty((0, 0))
        sent = spark.sparkContext.broadcast((ids, vectors, prepare(ids, vectors) if len(ids) else None))
        found = rows.mapInArrow(_task(sent, k, len(coordinates), nested, exact, leave_self, choose, first), schema)
        if first:
            at = found.groupBy("query_id", "distance_key").agg(F.min("ref_id").alias("ref_id"), F.sum("x").alias("x"))
            found = at.groupBy("query_id").agg(F.min(F.struct("distance_key", "ref_id", "x")).alias("m")).select("query_id", "m.ref_id", "m.distance_key", "m.x")
        top_k(found, k).write.mode("append").parquet(path)
        sent.destroy()
    answer = spark.read.schema(f"{schema}, rank int").parquet(path)
    return answer.select("query_id", "rank", "ref_id", "distance_key", (F.col("x").alias("tied") if first else F.col("x").cast(refs.schema[extra].dataType).alias(extra)))


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of so many rows together, as they come."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return [c.chunk(0) for c in table.columns]


def _task(sent, k: int, width: int, nested: bool, exact: bool, leave_self: bool, choose: Chooser | None, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, prepared = sent.value
        if not len(qid):
            return
        best = First(len(qid)) if first else Best(len(qid), k)
        if choose is None:
            asked, held = grouped(q, GROUP), parts(batches, max(PART // q.shape[1], 1))
        else:
            held = (b.columns for b in batches if b.num_rows)
        for columns in held:
            ids, extra = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[:2])
            r = _vectors(columns[2 : 2 + width], nested)
            more = [c.to_numpy(zero_copy_only=False) for c in columns[2 + width :]]
            pairs = near_pairs(asked, grouped(r, LEAF), ids, best) if choose is None else choose(prepared, more, ids, best)
            for some, those in pairs:
                for a in range(0, len(some), TILE):
                    rows = some[a : a + TILE]
                    for b in range(0, len(those), TILE):
                        cols = those[b : b + TILE]
                        left = qid[rows][:, None] == ids[cols][None, :] if leave_self else np.zeros((len(rows), len(cols)), bool)
                        if exact:
                            keys = exact_keys(q[rows], r[cols])
                            keys[left] = np.inf
                        else:
                            keys = float_keys_within(q[rows], r[cols], k, best.worst[rows], left)
                        best.add(rows, keys, ids[cols], extra[cols])
        keep = np.isfinite(best.key)
        names = np.broadcast_to(qid[:, None], best.key.shape)
        keys = best.key[keep]
        yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(best.id[keep]), pa.array(keys.astype(np.int64) if exact else keys), pa.array(best.extra[keep])], ["query_id", "ref_id", "distance_key", "x"])

    return run
