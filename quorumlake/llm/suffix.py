"""Suffix-array dedup of bytes by distributed prefix doubling.

Bytes covered by a 200-byte string that also starts anywhere else are removed.  A suffix array of
every byte position isn't needed for that: the window sieve of ``windows`` settles runs of windows
whose owner occurs once (unique) or that occur as a whole again (repeated past the threshold).  What it
leaves open is sorted by prefix doubling, in two grains:

1. Positions are cuts of at most ``SHORT`` neighbouring windows, with the bytes that all of them hold.
   A position's first rank is the fingerprint of its first ``FIRST`` bytes.  Spark then counts and sorts
   the pairs (rank at p, fingerprint of as many bytes at p + offset) and reranks, at offsets that double
   each round; positions whose rank has become unique leave, and the rounds end when none is left or
   the cut's length is reached.
2. In cuts that still share a rank, equal cuts are repeated; the windows of the others are ranked by
   pairs of pairs up to the threshold of 200 bytes.

Defined cases: null and empty texts have no bytes; matches never cross documents; equal rows are
copies of each other; rows of one id with different texts are different documents; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import discard, materialize, row_keys, sliced, small_side, text_of

WINDOW = 200
OWNER = 51
#: Windows in a cut.
SHORT = 8
#: Bytes of a position's first rank.
FIRST = 25
#: Bound of what may be broadcast: rows of a table of ranks.
MAX_BROADCAST_RANKS = 10_000


def _symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def candidate_runs(docs: DataFrame, window: int, owner: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = W.Powers(W.CHUNK + window + 1)
        for b in sliced(batches):
            parts, ids = [], []
            for id_, th, text in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2), strict=True):
                for part in W.runs(_symbols(text.as_py()), window, owner, powers):
                    parts.append(part)
                    ids.append((id_, th))
            yield W.packed(parts, ids)

    return docs.select(*row_keys(), text_of("text").cast("binary").alias("text")).mapInArrow(run, W.ROW)


def offsets(length: int, first: int = FIRST) -> list[tuple[int, int]]:
    """(offset, bytes taken in) of each round: what is known doubles until it is ``length`` bytes."""
    out, known = [], min(first, length)
    while known < length:
        step = min(known, length - known)
        out.append((known, step))
        known += step
    return out


def cuts(docs: DataFrame, open_rows: DataFrame, window: int, owner: int, short: int) -> DataFrame:
    """Open runs cut into runs of at most ``short`` windows: rows of ``ROW`` with the names b0, b1, ... of their common bytes.

    A window belongs to the cut of its distance from its owner, divided by ``short``.  Equal windows have
    equal distances, so they fall into the same cut.  b0 names the first bytes and the cut's number, b1
    and on the bytes that each round takes in.
    """
    parts_of = [(0, min(FIRST, window - short + 1)), *offsets(window - short + 1)]
    names = [f"b{i}" for i in range(len(parts_of))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = W.Powers(W.CHUNK + window + 1)
        for b in sliced(batches):
            parts, ids, many, taken = [], [], [], []
            for id_, th, text, at in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2), b.column(3), strict=True):
                raw = _symbols(text.as_py())
                for start, size, flag in map(W.unpack, at.as_py()):
                    part = raw[start : start + size + window - 1]
                    prefix = powers.prefix(part)
                    place = int(np.argmin(powers.of(prefix, np.arange(window - owner + 1), owner)))
                    cut = (place - np.arange(size)) // short
                    low = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
                    n = np.diff(np.append(low, size))
                    begin = place - cut[low] * short
                    part_names = [powers.of(prefix, begin + o, w) for o, w in parts_of]
                    part_names[0] = part_names[0] ^ W.mix(cut[low].astype(np.uint64))
                    taken.append(np.stack(part_names, axis=1).view(np.int64))
                    parts.append((np.zeros(len(low), np.uint64), powers.of(prefix, low, n + window - 1), low + start, n))
                    ids.append((id_, th))
                    many.append(np.full(len(low), flag))
            rows = W.packed(parts, ids, many)
            table = np.concatenate(taken) if taken else np.empty((0, len(names)), np.int64)
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], *(pa.array(table[:, i]) for i in range(len(names)))], [*rows.schema.names[1:], *names])

    return W.with_texts(docs, open_rows).mapInArrow(run, f"{W.ROW.removeprefix('key long, ')}, {', '.join(f'{n} long' for n in names)}")


def ranked(rows: DataFrame, rounds: int) -> DataFrame:
    """(c, key): the final rank of each of ``rows`` (c, many, b0, b1, ...) that isn't unique."""
    alive = rows.select("c", "many", *[f"b{i}" for i in range(rounds + 1)]).withColumnRenamed("b0", "rank")
    for i in range(1, rounds + 1):
        before = alive
        alive = materialize(rerank(alive.withColumnsRenamed({"rank": "a", f"b{i}": "b"}), f"cut-{i}"), f"suffix-alive-{i}")
        if i > 1:
            discard(before)
        if alive.isEmpty():
            break
    return alive.select("c", F.col("rank").alias("key"))


POSITION = "id long, th long, start long, many boolean"


def first_ranks(docs: DataFrame, open_rows: DataFrame, window: int) -> DataFrame:
    """Positions of the open runs with the ranks r0..r3 at distances of a quarter window.

    A first rank is the fingerprint of a quarter window of bytes; equal bytes, equal ranks.
    """
    quarter = window // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = W.Powers(W.CHUNK + window + 1)
        for b in sliced(batches):
            found: list[tuple] = []
            for id_, th, text, at in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2), b.column(3), strict=True):
                raw = _symbols(text.as_py())
                for start, size, flag in map(W.unpack, at.as_py()):
                    part = raw[start : start + size + window - 1]
                    prefix, p = powers.prefix(part), np.arange(size)
                    ranks = [powers.of(prefix, p + j * quarter, quarter).view(np.int64) for j in range(4)]
                    found.append((np.full(size, id_, np.int64), np.full(size, th, np.int64), p + start, np.full(size, flag), *ranks))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(8)], ["id", "th", "start", "many", "r0", "r1", "r2", "r3"])

    return W.with_texts(docs, open_rows).mapInArrow(run, f"{POSITION}, r0 long, r1 long, r2 long, r3 long")


def rerank(pairs: DataFrame, label: str) -> DataFrame:
    """``pairs`` (a, b, many, ...) that occur twice or more (``many`` counts as 2), with their ``rank`` in the order of (a, b).

    Equal pairs are counted before any sort, so a task sorts one row for each distinct pair however
    often a passage occurs; unique pairs end here.  The ranks are a table, joined to the positions by
    broadcast within a bound, else by a plain shuffle join whose hot pairs Spark can split.
    """
    again = pairs.groupBy("a", "b").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("total")).where("total > 1").select("a", "b")
    ordered = again.repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    ranks = materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), f"suffix-ranks-{label}")
    return pairs.join(small_side(ranks, MAX_BROADCAST_RANKS), ["a", "b"]).drop("a", "b")


def doubled(positions: DataFrame, window: int) -> DataFrame:
    """Repeated positions (id, th, start, n = 1) of ``positions`` as ``first_ranks`` gives them."""
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("r0").alias("a"), F.col("r1").alias("b")), F.struct(F.lit(1).alias("half"), F.col("r2").alias("a"), F.col("r3").alias("b")))).alias("h")
    alive = rerank(positions.select("id", "th", "start", "many", halves).select("id", "th", "start", "many", "h.*"), str(window // 2))
    rank = lambda i: F.max(F.when(F.col("half") == i, F.col("rank")))
    pairs = alive.groupBy("id", "th", "start", "many").agg(rank(0).alias("a"), rank(1).alias("b")).where("a is not null and b is not null")
    whole = rerank(materialize(pairs, "suffix-pairs"), str(window))
    return whole.where("not many").select("id", "th", "start", F.lit(1).alias("n"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, owner: int = OWNER, short: int = SHORT) -> DataFrame:
    """One row (id, th, at) for each text with repeated windows: ``at`` holds start, end, ... in bytes."""
    if window % 4 or not short <= owner <= window // 2:
        raise ValueError("the window is a multiple of 4 and the owner's width from the short run's to half of the window")
    done, open_rows = W.sieve(materialize(candidate_runs(docs, window, owner), "suffix-runs"), "suffix")
    rows = cuts(docs, open_rows, window, owner, short).withColumn("c", F.monotonically_increasing_id())
    rows = materialize(rows, "suffix-cuts")
    ranks = ranked(rows, len(offsets(window - short + 1)))
    alive = rows.join(small_side(ranks, MAX_BROADCAST_RANKS), "c").select("key", "span", "id", "th", "start", "n", "many")
    alive = materialize(alive, "suffix-alive")
    discard(rows)
    more, open_short = W.sieve(alive, "suffix-short")
    positions = materialize(first_ranks(docs, open_short, window), "suffix-positions")
    return W.ranges_of(done.union(more).union(doubled(positions, window)), window)


def remove_repeats(docs: DataFrame, window: int = WINDOW, owner: int = OWNER, short: int = SHORT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs`` (doc_id, text); ``kept`` is binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n, removed, spans, kept = [], [], [], []
            for text, at in zip(b.column(1), b.column(2), strict=True):
                raw, left, count = _symbols(text.as_py()), text.as_py(), 0
                if ranges := at.as_py():
                    mask = W.covered(np.array(ranges[::2]), np.array(ranges[1::2]), len(raw))
                    count = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + mask[0])
                    left = raw[~mask].tobytes()
                n.append(len(raw))
                removed.append(len(raw) - len(left))
                spans.append(count)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (n, removed, spans)], pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    ranges = repeated_spans(docs, window, owner, short)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), text_of("text").cast("binary").alias("text"))
    rows = W.join_lists(texts, ranges, "left").select("doc_id", "text", "at")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


#: On the text's hexadecimal digits, in blocks of 1000 window starts; repeated starts at most a window apart are one run.
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
j AS (SELECT r, x, unnest(range(0, len(x) // 2, 1000)) AS j FROM d),
p AS (SELECT r, j, substr(x, 2 * j + 1, {2 * (WINDOW + 999)}) AS p FROM j),
h AS (SELECT r, j, list_transform(range(0, len(p) // 2 - {WINDOW - 1}), lambda i: md5(substr(p, 2 * i + 1, {2 * WINDOW}))) AS l FROM p),
s AS MATERIALIZED (SELECT r, j + generate_subscripts(l, 1) - 1 AS i, unnest(l) AS h FROM h),
b AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
n AS (SELECT r, i, count_if(before IS NULL OR i > before + {WINDOW}) OVER (PARTITION BY r ORDER BY i) AS run FROM b),
e AS (SELECT r, run, min(i) AS a, max(i) + {WINDOW} AS z FROM n GROUP BY r, run),
g AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS y FROM e),
k AS (SELECT r, count(*) AS spans, sum(z - a) AS gone, string_agg(substr(x, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS t
      FROM g JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, x))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
