"""The join of near-dedup beyond its broadcast bound shuffles only rows that a bitmap marks."""

from pyspark.sql import functions as F

from quorumlake.llm import overlap
from quorumlake.llm.common import materialize


def test_same_rows_with_few_shuffled(spark, monkeypatch):
    rows = spark.range(2000).select((F.col("id") % 500 * 7_000_000_003 - 900_000_000_000).alias("key"), "id")
    side = materialize(rows.where("id % 500 < 20").select("key").distinct().withColumn("m", F.lit(4)), "side")
    want = sorted(map(tuple, rows.join(side, "key").collect()))
    assert len(want) == 80 and sorted(map(tuple, overlap.met(rows, side, "key").collect())) == want
    monkeypatch.setattr(overlap, "MAX_BROADCAST_ROWS", 0)
    beyond = overlap.met(rows, side, "key")
    assert sorted(map(tuple, beyond.collect())) == want
    assert "words" in beyond._jdf.queryExecution().optimizedPlan().toString()
