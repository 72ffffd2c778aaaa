"""Strata without a certified cutoff of their own."""

from quorumlake.llm import quality


def test_a_stratum_without_a_cutoff_rejects_nothing_beyond_the_base_rule(spark):
    labelled = [("en", i / 1000, True) for i in range(1000)] + [("xx", 0.9, True)] * 3
    cutoffs = quality.risk_controlled_cutoffs(spark.createDataFrame(labelled, "stratum string, score double, good boolean"), 0.3, 0.05)
    limit = {r.stratum: r.cutoff for r in cutoffs.collect()}
    assert limit.keys() == {"en", "*"} and limit["*"] < 0.9
    rows = [("xx", 0.9, False), ("xx", 0.9, True), (None, 0.9, False), ("en", 0.9, False), ("en", 0.1, False)]
    features = spark.createDataFrame(rows, "stratum string, score double, failed boolean")
    got = quality.with_verdict(features, cutoffs, "stratum", "score", "failed", "kept")
    assert got.columns == [*features.columns, "kept"]
    assert sorted((r.stratum or "", r.score, r.failed, r.kept) for r in got.collect()) == [("", 0.9, False, True), ("en", 0.1, False, True), ("en", 0.9, False, False), ("xx", 0.9, False, True), ("xx", 0.9, True, False)]


def test_rejections_by_cause(spark):
    rows = [("en", True, False), ("en", False, False), ("en", False, True), (None, True, False)]
    got = quality.rejections(spark.createDataFrame(rows, "stratum string, base_failed boolean, kept boolean")).collect()
    assert {tuple(r) for r in got} == {("en", 3, 1, 1), (None, 1, 1, 0)}
