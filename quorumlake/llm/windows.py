"""Exact sieve for repeated windows: what both exact-substring operators share.

A text is a sequence of symbols (bytes, or hashes of words); a window is ``length`` consecutive symbols
of one document.  To be found are the windows whose symbols also start anywhere else.

Winnowing: every window is owned by the place of its smallest hash of ``k`` symbols, leftmost of
equals.  Equal windows have the same owner at the same place in them, so equal windows can only be
found between owners of equal hash.  An owner's windows form one run, so a whole run is one row
(key: the owner's hash; span: a hash of all symbols of the run).  Per key, three cases:

* one row: every window of it is unique;
* several rows, all of one span: every window of them is repeated;
* several spans: open.  Rows whose span occurs twice are repeated; others remain as candidates.

Only open rows go on to finer work, one row for each distinct span.  Counting by key uses partial
sums, so a passage that a third of all documents share is one row from each task.

Hashes have 64 bits; keys only propose, spans are compared together with their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, discard, materialize, row_keys, sliced, small_side, tested, text_of

BASE = 0x9E3779B97F4A7C15
#: Symbols that are hashed at once; runs are cut there, which only moves the cut into the open case.
CHUNK = 1 << 18
#: Bounds of what may be broadcast: rows of a table of keys; texts, and numbers in their arrays.
MAX_BROADCAST_KEYS = 10_000
MAX_BROADCAST_TEXTS = 1_000
MAX_BROADCAST_ITEMS = 10_000
ROW = "key long, span long, id long, th long, start long, n int, many boolean"


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of MurmurHash3, a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of the hash base, from 0, up to the largest chunk."""

    def __init__(self, n: int):
        p = np.full(n, BASE, np.uint64)
        p[0] = 1
        self.up = np.multiply.accumulate(p)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        h = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols + np.uint64(1)) * self.up[: len(symbols)], out=h[1:])
        return h

    def of(self, prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of the parts [start, start + length): equal parts have equal values anywhere."""
        return mix((prefix[start + length] - prefix[start]) * self.up[len(self.up) - 1 - start])


def owners(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows of ``width`` hashes with one leftmost smallest hash: first window and owner of each.

    A window is the tail of one block of ``width`` places and the head of the next; running minima
    with their places, from both ends of each block, give its smallest hash in constant time.
    """
    n = len(h) - width + 1
    rows = np.concatenate([h, np.full(-len(h) % width, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    place = np.arange(rows.size).reshape(rows.shape)
    head = np.minimum.accumulate(rows, axis=1)
    lower = np.ones(rows.shape, bool)
    lower[:, 1:] = rows[:, 1:] < head[:, :-1]
    head_at = np.maximum.accumulate(np.where(lower, place, 0), axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]
    lower[:, :-1] = rows[:, :-1] <= tail[:, 1:]
    lower[:, -1] = True
    tail_at = np.minimum.accumulate(np.where(lower, place, rows.size)[:, ::-1], axis=1)[:, ::-1].ravel()
    left = tail.ravel()[:n] <= head.ravel()[width - 1 : width - 1 + n]
    owner = np.where(left, tail_at[:n], head_at[width - 1 : width - 1 + n])
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return cut, owner[cut]


def runs(symbols: np.ndarray, length: int, k: int, powers: Powers) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, span, start, n) of all runs of windows of a text, in chunks."""
    width = length - k + 1
    for a in range(0, len(symbols) - length + 1, CHUNK):
        part = symbols[a : a + CHUNK + length - 1]
        prefix = powers.prefix(part)
        h = powers.of(prefix, np.arange(len(part) - k + 1), k)
        start, owner = owners(h, width)
        n = np.diff(np.append(start, len(part) - length + 1))
        yield h[owner], powers.of(prefix, start, n + length - 1), start + a, n


def packed(parts: list[tuple[np.ndarray, ...]], ids: list[tuple[int, int]], many: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """A batch of ``ROW`` from runs and the row keys they belong to."""
    none = np.empty(0, np.int64)
    col = lambda i: np.concatenate([p[i] for p in parts]) if parts else none
    size = [len(p[0]) for p in parts]
    id_, th = (np.repeat(np.array([x[i] for x in ids], np.int64), size) if parts else none for i in (0, 1))
    flags = np.concatenate(many) if many else np.zeros(sum(size), bool)
    arrays = [pa.array(col(0).astype(np.uint64).view(np.int64)), pa.array(col(1).astype(np.uint64).view(np.int64)), pa.array(id_), pa.array(th), pa.array(col(2).astype(np.int64)), pa.array(col(3).astype(np.int32)), pa.array(flags)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "span", "id", "th", "start", "n", "many"])


def shared_runs(rows: DataFrame, label: str) -> DataFrame:
    """The (materialised) ``rows`` of ``ROW`` whose key occurs elsewhere, plus ``even``: all of the key's runs are equal.

    A bitmap of the shared keys keeps most other rows out of the join, whose hot keys Spark can split.
    """
    counts = rows.groupBy("key").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("total"), F.min("span").alias("low"), F.max("span").alias("high"))
    shared = materialize(counts.where("total > 1").select(F.col("key").alias("shared_key"), (F.col("low") == F.col("high")).alias("even")), f"{label}-keys")
    maps = bitmap(shared, "shared_key")
    held = tested(rows, "key", maps)[0].join(small_side(shared, MAX_BROADCAST_KEYS), F.col("key") == F.col("shared_key")).drop("shared_key")
    held = materialize(held, f"{label}-shared")
    discard(rows, shared, maps)
    return held


def distinct_runs(held: DataFrame, label: str) -> DataFrame:
    """One row of ``ROW`` for each key and span of ``held``; ``many`` marks what occurs twice or more."""
    kinds = held.groupBy("key", "span").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("total"), F.min(F.struct("id", "th", "start", "n")).alias("one"))
    return materialize(kinds.select("key", "span", "one.*", (F.col("total") > 1).alias("many")), f"{label}-kinds")


def sieve(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Repeated runs (id, th, start, n), and the open runs as rows of ``ROW``, one for each key and span.

    ``many`` marks rows that stand for several occurrences: their windows are repeated already and
    only serve as partners.
    """
    held = shared_runs(rows, label)
    mixed = held.where("not even")
    open_ = distinct_runs(mixed, label)
    more = open_.where("many").select(F.col("key").alias("k"), F.col("span").alias("s"))
    full = mixed.join(small_side(more, MAX_BROADCAST_KEYS), (F.col("key") == F.col("k")) & (F.col("span") == F.col("s")), "left_semi").where("not many")
    done = held.where("even and not many").select("id", "th", "start", "n").union(full.select("id", "th", "start", "n"))
    return done, open_


def small_lists(lists: DataFrame) -> bool:
    """Are rows and array elements of the (materialised) table within the broadcast bounds?"""
    rows, items = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    return rows <= MAX_BROADCAST_TEXTS and items <= MAX_BROADCAST_ITEMS


def join_lists(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``texts`` (id, th, ...) with the arrays of ``lists``: by broadcast within the bounds, else by a shuffle of the texts that a bitmap marks."""
    if small_lists(lists):
        return texts.join(F.broadcast(lists), ["id", "th"], how)
    some, others = tested(texts, "th", bitmap(lists, "th"))
    found = some.join(lists, ["id", "th"], how)
    return found.unionByName(others.withColumn("at", F.lit(None).cast("array<bigint>"))) if how == "left" else found


def with_texts(docs: DataFrame, open_rows: DataFrame) -> DataFrame:
    """The texts (id, th, text as bytes) of ``open_rows``, each with its rows as an array ``at``.

    An element holds start, n and many as start * 2048 + 2 * n + many; a run has fewer windows than a
    window has symbols.  A text's array holds at most its own windows.
    """
    packed_ = F.col("start") * 2048 + F.col("n") * 2 + F.col("many").cast("int")
    lists = materialize(open_rows.groupBy("id", "th").agg(F.collect_list(packed_).alias("at")), "windows-wanted")
    id_, th = row_keys()
    texts = docs.select(id_, th, text_of("text").cast("binary").alias("text"))
    return join_lists(texts, lists, "inner").select("id", "th", "text", "at")


def unpack(at: int) -> tuple[int, int, bool]:
    """(start, n, many) of an element of ``with_texts``."""
    return at >> 11, at >> 1 & 1023, bool(at & 1)


def ranges_of(spans: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows (id, th, start, n) to one row for each text: ``at``, the disjoint ranges of symbols as start, end, start, end..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for at in b.column(2):
                v = np.sort(at.values.to_numpy(zero_copy_only=False))
                start, end = v >> 11, (v >> 11) + (v >> 1 & 1023) + length - 1
                reach = np.maximum.accumulate(end)
                new = np.concatenate([[True], start[1:] > reach[:-1]])
                last = np.append(np.flatnonzero(new)[1:] - 1, len(v) - 1)
                out.append(np.stack((start[new], reach[last]), axis=1).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["id", "th", "at"])

    long = spans.where("n > 512").select("id", "th", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1, F.lit(512).cast("long"))).alias("o"), "start", "n")
    short = spans.where("n <= 512").select("id", "th", "start", "n").union(long.select("id", "th", F.col("start") + F.col("o"), F.least(F.lit(512), F.col("n") - F.col("o")).cast("int")))
    lists = short.groupBy("id", "th").agg(F.collect_set(F.col("start") * 2048 + F.col("n") * 2).alias("at"))
    return materialize(lists.mapInArrow(run, "id long, th long, at array<long>"), "windows-ranges")


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the ``n`` symbols inside any of the ranges."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0
