"""The pipeline, stage by stage, against plain Python; its registration."""

import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
from quorumlake.llm import quality
from quorumlake.llm.common import materialize

from .conftest import SF, WORD
from .test_near import norm
from .test_overlap import brute_kept


def test_stages(spark, docs):
    columns = docs.columns
    before = docs
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialize(stage(spark, before, SF), f"test-{i}")
        assert after.columns[: len(columns)] == columns and (i == 4 or after.columns == columns)
        out.append((before.collect(), after.collect()))
        before = after
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.judge(docs, labels).collect() if r.kept}
    assert {r.doc_id for r in out[0][1]} == kept and 0 < len(kept) < len(out[0][0])

    # the stage's contract: five-word shingles, similarity of 0.8 or more
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out[1][1]) == brute_kept([(r.doc_id, r.text) for r in out[1][0]])

    items = [Counter(norm(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def dirty(text):
        sh = norm(text)
        for b in items:
            n = sum(b.values())
            if not n or not b.keys() & set(sh):
                continue
            for s in range(max(len(sh) - n, 0) + 1):
                a = Counter(sh[s : s + n])
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    return True
        return False

    assert sorted(r.doc_id for r in out[2][1]) == sorted(r.doc_id for r in out[2][0] if not dirty(r.text))

    size = lambda r: len(re.findall(WORD, r.text or ""))
    times = Counter(r.doc_id for r in out[3][1])
    assert max(times.values()) <= 3 and times.keys() <= {r.doc_id for r in out[3][0]}
    assert abs(sum(map(size, out[3][1])) - sum(map(size, out[3][0]))) < 0.1 * sum(map(size, out[3][0]))

    assert Counter(r.doc_id for r in out[4][1]) == times
    held = Counter()
    for r in out[4][1]:
        held[r.shard] += len(r.text.encode())
    assert all(held[r.shard] == r.shard_bytes for r in out[4][1])


def test_registered(spark):
    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names
    assert __spark_entry__.oracle_sql().keys() <= names.keys()
    result = names["pipeline"](spark, SF)
    assert result.columns[-2:] == ["shard", "shard_bytes"] and result.count() > 0


def test_pipeline_on_odd_rows(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text", "lang", "source", "n_words")
    for _, stage in corpus_pipeline.STAGES:
        rows = materialize(stage(spark, rows, SF), "test-odd")
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_words", "shard", "shard_bytes"]
    assert Counter(r.doc_id for r in rows.collect())[None] == 0  # its seven words fail the base rule
    empty = odd_docs.limit(0).select("doc_id", "text", "lang", "source")
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, SF), "test-empty")
    assert empty.count() == 0
