"""Filtering stages of the pipeline decide by row where ids are null or reused."""

import corpus_pipeline

from .conftest import SF


def test_contamination_of_one_row_leaves_others_of_its_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, item), (None, "clean row"), (None, None), (7, f"before {item} after"), (7, "another clean row"), (8, "clean"), (8, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.decontamination_stage(spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[1], rows[2], *rows[4:]], key=str)


def test_near_copies_of_one_row_leave_others_of_its_id(spark):
    first, second, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, first), (2, first), (2, second), (3, third), (3, "words of their own"), (None, third), *[(None, "copies without an id")] * 50]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[4], rows[6]], key=str)
