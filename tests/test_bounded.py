"""Bounds of the SQL search and of the hash search."""

from pyspark.sql import functions as F

from quorumlake.functions.packing import COORDINATES
from quorumlake.operators import knn, lsh

from .test_core import as_set, brute, generated


def test_sql_search_is_bounded(spark, monkeypatch):
    refs, ask = generated(spark)
    monkeypatch.setattr(knn, "BOUND_PART", 2)
    asked = ask.select("query_id", *[F.col(c).alias(f"q_{c}") for c in COORDINATES])
    bound = {r.query_id: r.bound for r in knn._bounds(asked, refs, 5, False).collect()}
    want = brute(refs, ask, 5)
    assert len(bound) == 20 and all(bound[q] >= key for q, _, _, key, _ in want)
    assert as_set(knn.knn_sql(ask, refs, 5)) == want
    assert knn._bounds(asked, refs.limit(3), 5, False).count() == 0  # too few to bound


def test_hash_search_reads_all_stages_for_few_queries(spark, monkeypatch):
    refs, _ = generated(spark)
    copies = refs.unionByName(refs.withColumn("ref_id", F.col("ref_id") + 1000)).unionByName(refs.withColumn("ref_id", F.col("ref_id") + 2000))
    ask = refs.where("ref_id % 10 = 0").withColumnRenamed("ref_id", "query_id").drop("fraud")
    ix = lsh.index(copies).cache()
    want = {e: as_set(lsh.knn_lsh(ask, ix, 2, radius=3, enough=e, leave_self=True)) for e in (None, 2)}
    with monkeypatch.context() as m:  # every query through all stages
        m.setattr(lsh, "_bounds", lambda equal, ids, *more: ids * float("inf") if 0 not in ids else (ids + 1) * float("inf"))
        assert want == {e: as_set(lsh.knn_lsh(ask, ix, 2, radius=3, enough=e, leave_self=True)) for e in (None, 2)}
    monkeypatch.setattr(lsh, "_task", None)  # all queries have two copies in their own bucket
    assert want == {e: as_set(lsh.knn_lsh(ask, ix, 2, radius=3, enough=e, leave_self=True)) for e in (None, 2)}
