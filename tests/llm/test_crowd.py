"""Passages that many texts share stay out of near-dedup's prefixes; shuffle files go with their query."""

import random
from pathlib import Path

from quorumlake.llm import overlap
from quorumlake.llm.common import materialize

from .test_overlap import brute_kept, edited


def test_shared_passages_leave_the_prefixes(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SMALL", 8)
    monkeypatch.setattr(overlap, "CROWD", 8)
    monkeypatch.setattr(overlap, "SAMPLE", 10)  # so the sample misses the passages
    r = random.Random(5)
    passages = [[f"p{r.randrange(10**6)}" for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(160):
        base = [f"v{r.randrange(10**5)}" for _ in range(80)] + passages[i % 4]
        rows += [(3 * i + j, " ".join(edited(r, base, 0.01 * j))) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = overlap.order_of(docs)
    nodes = overlap.nodes_of(overlap.sets_of(docs, order))
    before = {x.node: set(x.prefix) for x in nodes.collect()}
    after, shared = overlap.spread(docs, nodes, order)
    assert max(sum(k in p for p in before.values()) for k in set().union(*before.values())) > 8
    assert max(x.m for x in shared.collect()) <= 8
    assert sorted(x.node for x in after.collect()) == sorted(before)
    assert sorted((False, x.doc_id) for x in overlap.drop_near_copies(docs).collect()) == brute_kept(rows)


def test_shuffle_files_go_with_their_query(spark):
    made = materialize(spark.range(1000).repartition(7, "id"), "shuffled")
    assert made.count() == 1000
    env = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = [Path(d.toString()) for d in env.localDirs()]
    before = sum(f.stat().st_size for d in held for f in d.rglob("shuffle_*.data"))
    materialize(spark.range(500_000).repartition(5, "id"), "shuffled")
    assert sum(f.stat().st_size for d in held for f in d.rglob("shuffle_*.data")) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
