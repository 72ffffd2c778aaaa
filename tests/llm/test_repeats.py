"""Substring and suffix-array dedup against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from quorumlake.llm import substring, suffix, windows

from .conftest import WORD


def brute(rows, symbols, length):
    """For each row: its symbols and the mask of those in windows that also start elsewhere."""
    seqs = [symbols(r.text or "") for r in rows]
    seen = Counter(hash_of(s[i : i + length]) for s in seqs for i in range(len(s) - length + 1))
    for r, s in zip(rows, seqs, strict=True):
        gone = [False] * len(s)
        until = 0
        for i in range(len(s)):
            if i + length <= len(s) and seen[hash_of(s[i : i + length])] > 1:
                until = i + length
            gone[i] = i < until
        yield r.doc_id, s, gone


def hash_of(x):
    return x if isinstance(x, bytes) else tuple(x)


def planted(spark, docs, odd_docs):
    r = random.Random(4)
    words = lambda n: [f"{r.choice('abcdefg')}{r.randrange(3000)}" for _ in range(n)]
    passage = words(90)
    rows = []
    for k in range(60):
        w = words(r.randrange(20, 200))
        for _ in range(r.randrange(3)):
            a = r.randrange(60)
            piece = passage[a : a + r.randrange(20, 90)]
            if r.random() < 0.5:
                piece[r.randrange(len(piece))] = "edit"
            at = r.randrange(len(w))
            w[at:at] = piece
        rows.append((20_000 + k, r.choice([" ", "\n", "  "]).join(w)))
    near = words(400)
    for k in range(40):
        w = list(near)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"z{r.randrange(9)}"
        rows.append((21_000 + k, " ".join(w)))
    rows += [(22_000, "ab " * 400), (22_001, "abc" * 300), (22_002, "a" * 5000), (None, "b" * 450), (None, None)]
    return docs.select("doc_id", "text").limit(120).union(odd_docs.select("doc_id", "text")).union(spark.createDataFrame(rows, "doc_id long, text string"))


def check_words(df, **kw):
    rows = df.collect()
    want = Counter()
    for d, s, gone in brute(rows, lambda t: re.findall(WORD, t), 35):
        left = " ".join(w for w, g in zip(s, gone, strict=True) if not g)
        want[d, len(s), sum(gone), left] += 1
    got = Counter(map(tuple, substring.remove_repeats(df, **kw).collect()))
    assert got == want
    return sum(k[2] for k in want)


def test_substring_dedup(spark, docs, odd_docs, monkeypatch):
    df = planted(spark, docs, odd_docs)
    assert check_words(df) > 1000
    monkeypatch.setattr(windows, "MAX_BROADCAST_TEXTS", 0)  # joins by shuffle
    assert check_words(df, shard_words=300) > 1000  # large shards by windows
    assert substring.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [0, windows.MAX_BROADCAST_TEXTS])
def test_suffix_dedup(spark, docs, odd_docs, monkeypatch, texts):
    monkeypatch.setattr(windows, "MAX_BROADCAST_TEXTS", texts)  # 0: joins by shuffle
    monkeypatch.setattr(suffix, "MAX_BROADCAST_RANKS", texts)
    df = planted(spark, docs, odd_docs)
    want = Counter()
    for d, s, gone in brute(df.collect(), str.encode, 200):
        left = bytes(np.frombuffer(s, np.uint8)[~np.array(gone, bool)]) if s else b""
        starts = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[d, len(s), sum(gone), starts, hashlib.sha256(left).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.remove_repeats(df).collect())
    assert got == want
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_ranks_follow_the_order_of_repeated_pairs(spark):
    rows = [(i, a, b, m) for i, (a, b, m) in enumerate([(5, 1, False)] * 400 + [(5, 0, False), (-3, 7, True), (2, 2, False), (2, 2, False), (9, 9, False)])]
    got = suffix.rerank(spark.createDataFrame(rows, "p int, a long, b long, many boolean"), "test").collect()
    pair = {i: (a, b) for i, a, b, _ in rows}
    assert {r.p for r in got} == {*range(400), 401, 402, 403}
    by_rank = sorted({(r["rank"], pair[r.p]) for r in got})
    assert [p for _, p in by_rank] == [(-3, 7), (2, 2), (5, 1)]


def test_owners_are_leftmost_minima():
    r = np.random.default_rng(1)
    for n, width, top in [(50, 7, 5), (300, 150, 10**9), (150, 150, 3), (1000, 28, 40)]:
        h = r.integers(0, top, n).astype(np.uint64)
        start, owner = windows.owners(h, width)
        want = np.array([i + int(np.argmin(h[i : i + width])) for i in range(n - width + 1)])
        got = np.repeat(owner, np.diff(np.append(start, n - width + 1)))
        assert (got == want).all()


def test_chunks_do_not_change_results(monkeypatch, spark, docs, odd_docs):
    monkeypatch.setattr(windows, "CHUNK", 1 << 10)
    r = random.Random(2)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(900))
    a, b = substring.word_hashes(text.encode(), windows.Powers((1 << 10) + 36)), text.split()
    assert len(a) == len(b) and len(set(a.tolist())) == len(set(b))
    parts = list(windows.runs(a, 35, 8, windows.Powers((1 << 10) + 36)))
    assert sum(int(p[3].sum()) for p in parts) == len(a) - 34


def test_automaton_counts_repeats():
    r = random.Random(8)
    for _ in range(200):
        seqs = [[r.randrange(3) for _ in range(r.randrange(1, 14))] for _ in range(4)]
        sam = substring.Automaton()
        for s in seqs:
            sam.add(s, 1)
        sam.close()
        seen = Counter(tuple(s[i : i + 3]) for s in seqs for i in range(len(s) - 2))
        for s in seqs:
            want = {k for i in range(len(s) - 2) if seen[tuple(s[i : i + 3])] > 1 for k in range(i, i + 3)}
            assert {k for a, b in sam.repeated(s, 3) for k in range(a, b)} == want


def test_offsets_double_until_the_length():
    assert suffix.offsets(193) == [(25, 25), (50, 50), (100, 93)]
    assert suffix.offsets(20) == [] and suffix.offsets(25) == []
    assert suffix.offsets(51, 3) == [(3, 3), (6, 6), (12, 12), (24, 24), (48, 3)]


def test_ranks_of_cuts_by_rounds(spark):
    """Rows that agree in all names share a rank, unique ones leave, and the rounds end early when none is left."""
    r = random.Random(6)
    rows = [(i, r.random() < 0.1, *[r.randrange(3) for _ in range(4)]) for i in range(200)]
    count = Counter()
    for _, many, *names in rows:
        count[tuple(names)] += 2 if many else 1
    got = {x.c: x.key for x in suffix.ranked(spark.createDataFrame(rows, "c long, many boolean, b0 long, b1 long, b2 long, b3 long"), 3).collect()}
    assert got.keys() == {c for c, _, *names in rows if count[tuple(names)] > 1}
    groups = {}
    for c, _, *names in rows:
        if c in got:
            groups.setdefault(tuple(names), set()).add(got[c])
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)
    lone = spark.createDataFrame([(i, False, i, 0, 0, 0) for i in range(9)], "c long, many boolean, b0 long, b1 long, b2 long, b3 long")
    assert suffix.ranked(lone, 3).count() == 0


def test_discarded_tables_are_gone(spark):
    from pathlib import Path

    from quorumlake.llm.common import discard, materialize

    kept, gone = materialize(spark.range(3), "test-kept"), materialize(spark.range(3), "test-gone")
    discard(gone, spark.range(1))
    assert Path(kept.table_path).exists() and not Path(gone.table_path).exists() and kept.count() == 3
