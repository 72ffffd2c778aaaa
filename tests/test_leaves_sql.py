"""The SQL search compares a query with near leaves only."""

from pyspark.sql import functions as F

from quorumlake.operators import knn

from .test_core import as_set, brute, generated


def test_sql_search_by_leaves(spark, monkeypatch):
    refs, ask = generated(spark)
    monkeypatch.setattr(knn, "LEAF", 4)
    leaved = knn._leaved(refs)
    assert leaved.select(*refs.columns).exceptAll(refs).isEmpty() and leaved.count() == refs.count()
    assert knn._boxes(leaved).count() >= refs.count() / 4
    assert leaved.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 4
    assert as_set(knn.knn_sql(ask, refs, 5)) == brute(refs, ask, 5)
