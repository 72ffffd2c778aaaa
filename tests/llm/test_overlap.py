"""Near copies of the pipeline against brute-force Jaccard similarity."""

import random
import re

import corpus_pipeline
import pytest
from quorumlake.llm import overlap

from .conftest import SF, WORD


def shingles(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_kept(rows):
    """Rows (id, text) that stay: of each component the smallest (no id, id)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 4 * (len(a) + len(sets[j]) - both) > 0:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((d is None, d or 0))
    return sorted(min(g) for g in groups.values())


def edited(r, words, share):
    return [w if r.random() > share else f"e{r.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("small", [2, 64])
def test_near_copies_by_brute_force(spark, docs, odd_docs, small, monkeypatch):
    monkeypatch.setattr(overlap, "SMALL", small)
    monkeypatch.setattr(overlap, "BLOCK", 8)
    r = random.Random(small)
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text")).collect()]
    for _ in range(25):
        base = [f"v{r.randrange(3000)}" for _ in range(r.choice([12, 60, 300, 900]))]
        for _ in range(r.choice([2, 3, 25])):
            rows.append((r.choice([None, r.randrange(20_000, 10**6)]), " ".join(edited(r, base, r.choice([0, 0.01, 0.02, 0.03])))))
    got = overlap.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == brute_kept(rows)
    assert overlap.drop_near_copies(docs.limit(0)).count() == 0


def test_stage_takes_copies_beyond_four_bits_and_keeps_other_rows(spark):
    r = random.Random(1)
    base = [f"v{i}" for i in range(200)]
    near = list(base)
    near[50], near[150] = "x", "y"  # ten of 196 shingles differ
    other = " ".join(f"o{i}" for i in range(100))
    rows = [(1, " ".join(base)), (2, " ".join(near)), (2, other), (None, "a copy without id " * 3), (None, "a copy without id " * 3), (None, " ".join(r.sample(base, 150)))]
    stage = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(tuple, stage.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)


def test_stage_after_quality_rules(spark, docs):
    before = [(x.doc_id, x.text) for x in corpus_pipeline.quality_stage(spark, docs, SF).collect()]
    after = corpus_pipeline.near_dedup_stage(spark, corpus_pipeline.quality_stage(spark, docs, SF), SF)
    assert after.columns == docs.columns
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in after.collect()) == brute_kept(before)


def test_fingerprints_link_what_differs_little(spark):
    """The SimHash part alone: it links near copies only, among them all that differ in few bits."""
    r = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"v{r.randrange(3000)}" for _ in range(400)]
        rows += [(100 * g + i, " ".join(edited(r, base, r.choice([0, 0.001, 0.003, 0.02])))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = overlap.sets_of(docs)
    text = {x.node: dict(rows)[x.id] for x in nodes.collect()}
    prints = {x.node: x.fp & (2**64 - 1) for x in nodes.collect()}
    distinct = overlap.materialize(nodes.dropDuplicates(["node"]), "test-nodes")
    edges = [(e.a, e.b) for e in overlap.fingerprint_links(docs, distinct).collect()]
    sets = {n: shingles(t) for n, t in text.items()}
    assert edges and all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in edges)
    root = {n: n for n in text}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[find(a)] = find(b)
    close = [(a, b) for a in text for b in text if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(close) > 10 and sum(find(a) == find(b) for a, b in close) >= 0.9 * len(close)
