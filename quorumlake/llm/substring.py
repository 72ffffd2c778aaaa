"""Substring dedup by suffix automata of reference shards.

Words covered by a window of 35 consecutive words that also starts anywhere else are removed.  The
reference is the corpus itself, so its automata grow with it and can't be broadcast within any
proven bound; instead the corpus is sharded by the window sieve of ``windows``: only runs whose
windows can repeat remain, one for each distinct word sequence with its number of occurrences, and
all runs that could share a window meet in one shard.  Each task builds the suffix automaton of its
shard's runs, streams the runs through it for matching statistics (at each word, the longest suffix
that occurs at least twice), and returns the maximal spans of at least 35 words, which then hold
wherever the run occurs.  So every removed word is found by an automaton, but for one case:

A shard of more than ``SHARD_WORDS`` words of one key is cut by windows instead: each of its windows
becomes a shard row of its own, keyed by the window's hash, so a hot passage spreads over tasks.

Words are compared by 64-bit hashes.  Defined cases: null and empty texts have no words; a text that
repeats itself counts like two texts; equal rows are copies of each other; rows of one id with
different texts are different documents; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import discard, materialize, row_keys, sliced, small_side, text_of

WINDOW = 35
OWNER = 8
SHARD_WORDS = 1 << 17
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def word_ends(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of a text's bytes."""
    inside = np.concatenate([[False], ~_SPACES[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(text: bytes, powers: W.Powers) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_ends(raw)
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):  # parts of whole words that fit the powers; a longer word is hashed in one go
        low = starts[done]
        stop = max(int(np.searchsorted(ends, low + W.CHUNK, side="right")), done + 1)
        part = raw[low : ends[stop - 1]].astype(np.uint64)
        if len(part) > W.CHUNK:
            digest = hashlib.blake2b(part.astype(np.uint8).tobytes(), digest_size=8).digest()
            out[done] = int.from_bytes(digest, "little")
        else:
            out[done:stop] = powers.of(powers.prefix(part), starts[done:stop] - low, ends[done:stop] - starts[done:stop])
        done = stop
    return out


class Automaton:
    """Suffix automaton of several sequences, with the number of places at which each state's strings end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], weight: int) -> None:
        nxt, link, size, count = self.next, self.link, self.size, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q  # the string is known from an earlier sequence
                count[last] += weight
                continue
            if q is not None:
                last = self._clone(last, c, q)
                count[last] += weight
                continue
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            count.append(weight)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, size, count = self.next, self.link, self.size, self.count
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        count.append(0)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def close(self) -> None:
        """Adds up the ends along the suffix links, longest strings first."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def repeated(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal ranges of ``sequence``, which is part of the automaton, covered by strings of ``least`` or more that occur twice."""
        out: list[list[int]] = []
        nxt, link, size, count = self.next, self.link, self.size, self.count
        state = 0
        for i, c in enumerate(sequence, 1):
            while c not in nxt[state]:
                state = link[state]
            state = nxt[state][c]
            while count[state] < 2:
                state = link[state]
            if size[state] >= least:
                start = i - size[state]
                if out and start <= out[-1][1]:
                    out[-1] = [min(start, out[-1][0]), i]
                else:
                    out.append([start, i])
        return [(a, b) for a, b in out]


def candidate_runs(docs: DataFrame, window: int, owner: int) -> DataFrame:
    """Runs of windows of all texts, as rows of ``windows.ROW``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = W.Powers(W.CHUNK + window + 1)
        for b in sliced(batches):
            parts, ids = [], []
            for id_, th, text in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2), strict=True):
                for part in W.runs(word_hashes(text.as_py(), powers), window, owner, powers):
                    parts.append(part)
                    ids.append((id_, th))
            yield W.packed(parts, ids)

    return docs.select(*row_keys(), text_of("text").cast("binary").alias("text")).mapInArrow(run, W.ROW)


SEGMENT = "key long, span long, many boolean, words array<long>"


def _segments(docs: DataFrame, runs: DataFrame, window: int, owner: int) -> DataFrame:
    """The distinct runs with their words, as rows of ``SEGMENT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = W.Powers(W.CHUNK + window + 1)
        for b in sliced(batches):
            out: list[tuple] = []
            for _, _, text, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = word_hashes(text, powers)
                for start, n, many in map(W.unpack, at):
                    part = words[start : start + n + window - 1]
                    prefix = powers.prefix(part)
                    # the run's key again: the smallest hash of its first window, as all of its windows have it
                    key = powers.of(prefix, np.arange(window - owner + 1), owner).min()
                    span = powers.of(prefix, np.zeros(1, np.int64), len(part))[0]
                    out.append((int(key.astype(np.int64)), int(span.astype(np.int64)), many, part.view(np.int64)))
                if len(out) > 4096:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return W.with_texts(docs, runs).mapInArrow(run, SEGMENT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "span", "many", "words"])


FOUND = "key long, span long, a long, n int"


def _match(shards: DataFrame, window: int) -> DataFrame:
    """Repeated windows of the runs of each shard, as rows of ``FOUND``: the first one's place in the run, and how many."""

    def spans(rows: list[tuple]) -> list[tuple]:
        sam = Automaton()
        for r in rows:
            sam.add(r[3], 2 if r[2] else 1)
        sam.close()
        return [(r[0], r[1], a, b - a - window + 1) for r in rows for a, b in sam.repeated(r[3], window)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            found = spans(rows)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["key", "span", "a", "n"])

        for b in sliced(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # a shard is any number of whole keys: it ends with a key once it is large enough
                if size > SHARD_WORDS // 4 and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        yield out(held)

    return shards.repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def _by_window(segments: DataFrame, window: int) -> DataFrame:
    """The same for keys that are too large for one task: counts of single windows."""
    place = F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("i")
    each = segments.select("key", "span", "many", "words", place).select("key", "span", "many", "i", F.xxhash64(F.slice("words", F.col("i") + 1, window)).alias("h1"), F.hash(F.slice("words", F.col("i") + 1, window)).alias("h2"))
    each = materialize(each, "substring-windows")
    twice = each.groupBy("h1", "h2").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("total")).where("total > 1").select("h1", "h2")
    return each.join(twice, ["h1", "h2"], "left_semi").select("key", "span", F.col("i").cast("long").alias("a"), F.lit(1).alias("n"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, owner: int = OWNER, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row (id, th, at) for each text with repeated windows: ``at`` holds start, end, ... in words."""
    held = W.shared_runs(materialize(candidate_runs(docs, window, owner), "substring-runs"), "substring")
    runs = W.distinct_runs(held, "substring")
    segments = materialize(_segments(docs, runs, window, owner), "substring-segments")
    large = materialize(segments.groupBy("key").agg(F.sum(F.size("words")).alias("size")).where(F.col("size") > shard_words).select(F.col("key").alias("large_key")), "substring-large")
    if large.isEmpty():
        found = _match(segments, window)
    else:
        side = small_side(large, W.MAX_BROADCAST_KEYS)
        small = segments.join(side, F.col("key") == F.col("large_key"), "left_anti")
        found = _match(small, window).union(_by_window(segments.join(side, F.col("key") == F.col("large_key"), "left_semi"), window))
    found = materialize(found, "substring-found")
    discard(segments, runs)
    # what holds for a run holds wherever it occurs
    to = small_side(found.select(F.col("key").alias("k"), F.col("span").alias("s"), "a", F.col("n").alias("m")), W.MAX_BROADCAST_KEYS)
    spans = held.join(to, (F.col("key") == F.col("k")) & (F.col("span") == F.col("s"))).select("id", "th", (F.col("start") + F.col("a")).alias("start"), F.col("m").alias("n"))
    return W.ranges_of(spans, window)


def remove_repeats(docs: DataFrame, window: int = WINDOW, owner: int = OWNER, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs`` (doc_id, text); ``kept`` is the text left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n, removed, kept = [], [], []
            for text, at in zip(b.column(1), b.column(2), strict=True):
                words = _WORD.findall(text.as_py())
                n.append(len(words))
                if ranges := at.as_py():
                    mask = W.covered(np.array(ranges[::2]), np.array(ranges[1::2]), len(words))
                    words = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    ranges = repeated_spans(docs, window, owner, shard_words)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), text_of("text").cast("binary").alias("text"))
    rows = W.join_lists(texts, ranges, "left").select("doc_id", "text", "at")
    left = rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return left.withColumn("kept", F.col("kept").cast("string"))


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
h AS (SELECT r, list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: md5(array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS l FROM d),
s AS MATERIALIZED (SELECT r, unnest(l) AS h, generate_subscripts(l, 1) AS i FROM h),
b AS (SELECT r, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS i FROM b, range(0, {WINDOW}) q(k)),
u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM u ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
