"""Searches compare only what can be near, and lose nothing by it."""


import numpy as np
import pytest

from quorumlake.functions.packing import COORDINATES
from quorumlake.operators import blocks, knn, leaves

from .test_core import generated


def points(n, seed):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 4, (n, 6)) * 1000.0 + rng.integers(0, 9, (n, 6))


@pytest.mark.parametrize("exact", [True, False])
def test_few_pairs_give_the_same_neighbors(exact):
    q, r, k = points(60, 1), points(20_000, 2), 5
    ids = np.random.default_rng(3).permutation(len(r))
    best, compared = blocks.Best(len(q), k), 0
    none = np.zeros(len(r), np.int64)
    for rows, cols in leaves.near_pairs(leaves.grouped(q, 4), leaves.grouped(r, 64), ids, best):
        compared += len(rows) * len(cols)
        left = np.zeros((len(rows), len(cols)), bool)
        keys = blocks.exact_keys(q[rows], r[cols]) if exact else blocks.float_keys_within(q[rows], r[cols], k, best.worst[rows], left)
        best.add(rows, keys, ids[cols], none)
    assert compared < len(q) * len(r) / 4
    for i in range(len(q)):
        keys = ((q[i] - r) ** 2).sum(axis=1)
        order = np.lexsort((ids, keys))[:k]
        assert best.id[i].tolist() == ids[order].tolist() and best.key[i].tolist() == keys[order].tolist()


def test_first_neighbor_counts_its_ties(spark, monkeypatch):
    refs, _ = generated(spark)
    ask = refs.where("ref_id % 7 = 0").withColumnRenamed("ref_id", "query_id").drop("fraud")
    monkeypatch.setattr(blocks, "TILE", 4)
    got = {r.query_id: (r.ref_id, r.tied) for r in knn.knn_first(ask, refs.repartition(3), leave_self=True).collect()}
    rows = [(r.ref_id, [r[c] for c in COORDINATES]) for r in refs.collect()]
    for q, v in ((r.query_id, [r[c] for c in COORDINATES]) for r in ask.collect()):
        keys = {i: sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for i, w in rows if i != q}
        first = [i for i, key in keys.items() if key == min(keys.values())]
        assert got.pop(q) == (min(first), len(first))
    assert not got
