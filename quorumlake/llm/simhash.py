"""Near-duplicates by SimHash with deletion-variant signatures.

A fingerprint has 64 bits over the XXH64 of the text's word shingles.  For at most 4 differing bits
it is cut into 3 segments (21, 21 and 22 bits), so that one segment differs by at most one bit.
Every segment is indexed under each of its one-wildcard variants (one bit left out): 64 keys for a
fingerprint, and two fingerprints within the radius share at least one key.  Members of a key are
compared exactly.  Links are kept as spanning forests of each key, which loses no component and
never emits all pairs of a dense group.

Keys are dealt over tasks.  A key of more than ``BLOCK`` distinct fingerprints (its size follows
exactly from the counts of segment values) is cut into blocks, and every pair of blocks is a group
of its own, so no task holds more than two blocks of one key.

Defined cases: null and empty texts have the fingerprint zero and link like any other; a text of
fewer words than a shingle is one shingle; a null id links its document, but is never a
component id unless the component has no other; equal texts and repeated rows share one node; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, discard, materialize, row_keys, sliced, small_side, text_of, without_rows

SHINGLE = 4
RADIUS = 4
SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))
BLOCK = 2048
MAX_BROADCAST_ROWS = 1_000_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    import xxhash

    joined = b" ".join(_WORD.findall(text.translate(_LOWER)))
    if not joined:
        return 0
    ends = np.flatnonzero(np.frombuffer(joined + b" ", np.uint8) == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(ends) - shingle + 1, 1)
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    first, end = starts[:last].tolist(), ends[min(shingle, len(ends)) - 1 :].tolist()
    for i in range(0, last, _CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(first[i : i + _CHUNK], end[i : i + _CHUNK], strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > last, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, id, th, fp) for each row of ``docs`` (doc_id, text); id and th as from ``row_keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = [_signed(fingerprint(t.as_py(), shingle)) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps, pa.int64())], ["doc_id", "id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), text_of("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, id long, th long, fp long")


def _wild_keys(value: Column, low: int, width: int) -> Column:
    """The segment's one-wildcard keys: bit number above the segment's other bits."""
    return F.transform(F.array(*[F.lit(j) for j in range(width)]), lambda j: (F.lit(low).cast("long") + j) * (1 << 32) + value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j))))


def _segment(fp: Column, low: int, width: int) -> Column:
    return F.call_function("shiftrightunsigned", fp, F.lit(low)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def index(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``fps`` (fp, distinct) to (key, a, b, fp): a row for each variant, or for each block pair of a large key."""
    keys = F.concat(*[_wild_keys(_segment(F.col("fp"), lo, w), lo, w) for lo, w in SEGMENTS])
    rows = fps.select("fp", F.explode(keys).alias("key"))
    segments = F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _segment(F.col("fp"), lo, w).alias("value")) for i, (lo, w) in enumerate(SEGMENTS)])).alias("s")
    counts = fps.select(segments).groupBy("s.seg", "s.value").agg(F.count("*").alias("n")).where(F.col("n") > block // 2)
    wild = F.when(F.col("seg") == 0, _wild_keys(F.col("value"), *SEGMENTS[0])).when(F.col("seg") == 1, _wild_keys(F.col("value"), *SEGMENTS[1])).otherwise(_wild_keys(F.col("value"), *SEGMENTS[2]))
    large = materialize(counts.select("n", F.explode(wild).alias("large_key")).groupBy("large_key").agg((F.ceil((F.sum("n") + block // 2) / block)).cast("int").alias("blocks")), "simhash-large-keys")
    if large.isEmpty():
        return rows.select("key", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp")
    joined = rows.join(small_side(large, MAX_BROADCAST_ROWS), F.col("key") == F.col("large_key"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return joined.select("key", mine.alias("mine"), other, "fp").select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp")


def _forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of at most ``radius`` bits connect: a star for each component of ``x``."""
    left, a, b = x, [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        edge = np.array([root])
        while len(edge) and len(left):
            now, edge = edge[:64], edge[64:]
            near = (np.bitwise_count(now[:, None] ^ left[None, :]) <= radius).any(axis=0)
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), root))
                b.append(found)
                edge = np.concatenate((edge, found))
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _linked(keys: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of whole runs of equal ``keys``."""
    cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    first = np.concatenate(([0], cut))
    length = np.diff(np.concatenate((first, [len(fp)])))
    pairs = first[length == 2]
    ok = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= radius
    a, b = [fp[pairs][ok]], [fp[pairs + 1][ok]]
    for s, n in zip(first[length > 2].tolist(), length[length > 2].tolist(), strict=True):
        p, q = _forest(fp[s : s + n], radius)
        a.append(p)
        b.append(q)
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints with the components of all links within ``radius``."""
    if radius // len(SEGMENTS) > 1:
        raise ValueError(f"the segments cover at most {2 * len(SEGMENTS) - 1} differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps_ = np.empty((0, 3), np.int64), np.empty(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _linked(k, f, radius) if len(f) > 1 else (f[:0], f[:0])
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64))], ["a", "b"])

        for batch in batches:
            k, a, b, f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            keys = np.concatenate((keys, np.stack((k, a.astype(np.int64), b.astype(np.int64)), axis=1)))
            fps_ = np.concatenate((fps_, f.view(np.uint64)))
            if not len(keys):
                continue
            done = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys[0] != keys[-1]).any() else 0
            if done:  # the last run may go on in the next batch
                yield out(keys[:done], fps_[:done])
                keys, fps_ = keys[done:], fps_[done:]
        yield out(keys, fps_)

    rows = index(fps, block).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return rows.mapInArrow(run, "a long, b long").distinct()


def candidate_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) of nodes that may be alike: ``prints`` (node, fp), one row a node; forests as of ``links``, and equal fingerprints."""
    first = materialize(prints.groupBy("fp").agg(F.min("node").alias("rep")), "simhash-reps")
    same = prints.join(first, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    end = lambda c: first.select(F.col("fp").alias(f"fp_{c}"), F.col("rep").alias(c))
    apart = links(first.select("fp"), radius).toDF("fp_a", "fp_b").join(end("a"), "fp_a").join(end("b"), "fp_b").select("a", "b")
    return same.union(apart)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): minimum labels with pointer jumping."""
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "cc-edges")
    table = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "cc-labels")
    while True:
        labels = table.select("node", "root")
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        moved = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        # the root is a node itself: take the root's own label
        jumped = moved.join(labels.select(F.col("node").alias("root"), F.col("root").alias("up")), "root").select("node", "old", F.least("root", "up").alias("root"))
        before, table = table, materialize(jumped, "cc-labels")
        discard(before)
        if table.where("old <> root").isEmpty():
            discard(both)
            return table.select("node", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text)."""
    fps = materialize(fingerprints(docs, shingle).select("doc_id", "fp"), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(named.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of smallest id, then text hash; an id before none.

    Decisions are by id and text, so a null or reused id never decides for another text; of rows
    equal in both one stays.  Columns unchanged.
    """
    fps = materialize(fingerprints(docs, shingle), "simhash-rows")
    roots = components(links(fps.select("fp").distinct(), radius))
    named = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rows = materialize(named.groupBy("root", "id", "th").agg(F.count("*").alias("times")), "simhash-named")
    first = rows.groupBy("root").agg(F.min(F.struct((F.col("id") == NO_ID).alias("none"), "id", "th")).alias("m")).select("m.id", "m.th")
    first = materialize(first, "simhash-first")
    gone = materialize(rows.select("id", "th").join(first, ["id", "th"], "left_anti"), "simhash-gone")
    again = materialize(rows.where("times > 1").select("id", "th").join(first, ["id", "th"], "left_semi"), "simhash-again")
    return without_rows(docs, list(row_keys()), gone, again, MAX_BROADCAST_ROWS)
