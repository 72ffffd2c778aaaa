"""Rows without an id, rows that share one, and copies of one row are told apart by every operator that drops or places rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quorumlake.llm import common, decontam, mixing, overlap, sharding, simhash

from .conftest import SF, WORD

CLASH = ("bad_id", "gone_id", "again_id", "id", "th", "row", "copy", "root", "h", "bytes", "gone", "again", "k_0__", "depth", "oversize", "with.dot", "m_row", "cut")


def with_clashes(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


def prose(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def test_contaminated_rows_leave_clean_rows(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy("item_id").first().text
    rows = [(None, item), (None, "clean text"), (None, prose("a")), (7, f"before {item} after"), (7, prose("b")), (None, item)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)
    found = decontam.contaminated(docs, bench).collect()
    assert Counter(r.doc_id for r in found) == {None: 1, 7: 1} and all(r.similarity >= 0.8 for r in found)


def test_windows_of_long_documents_come_from_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART", 64)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r.text for r in bench.orderBy("item_id").limit(3).collect()]
    long = " ".join([prose("x", 150), items[0], prose("y", 61), items[1], prose("z", 700), items[2]])
    docs = spark.createDataFrame([(1, long), (2, prose("q", 500))], "doc_id long, text string")
    whole = {r.item_id: (r.start_word, r.similarity) for r in decontam.contaminated(docs, bench).collect()}
    ids = [r.item_id for r in bench.orderBy("item_id").limit(3).collect()]
    assert whole.keys() >= set(ids) and all(whole[i][1] == 1.0 for i in ids)
    assert whole[ids[0]][0] == 150 and whole[ids[2]][0] == len(long.split()) - len(items[2].split())


def test_bitmaps_hold_all_and_little_more(spark, monkeypatch):
    r = random.Random(1)
    values = [r.getrandbits(64) - (1 << 63) for _ in range(20_000)]
    held = set(values[:5000])
    maps = common.bitmap(spark.createDataFrame([(v,) for v in held], "v long"), "v")
    rows = spark.createDataFrame([(v,) for v in values], "x long")
    maybe, surely = ([x.x for x in part.collect()] for part in common.tested(rows, "x", maps))
    assert Counter(maybe + surely) == Counter(values) and held <= set(maybe) and len(maybe) < 5020
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 15)
    maps = common.bitmap(spark.createDataFrame([(v,) for v in held], "v long"), "v")
    maybe, surely = (len(part.collect()) for part in common.tested(rows, "x", maps))
    assert maybe + surely == 20_000 and 6000 < maybe < 9000


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_rows_are_dropped_by_broadcast_and_by_bitmap(spark, bound):
    rows = [(i % 7, f"t{i % 50}", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    key = docs.select(*common.row_keys(), "text")
    gone, once = (common.materialize(key.where(c).select("id", "th").distinct(), "test-keys") for c in ("text < 't2'", "text like 't3%'"))
    left = common.without_rows(docs, list(common.row_keys()), gone, once, bound).collect()
    want = Counter((d, t) for d, t, _ in rows if t >= "t2")
    assert Counter((x.doc_id, x.text) for x in left) == Counter({k: 1 if k[1].startswith("t3") else n for k, n in want.items()})


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, overlap.drop_near_copies])
def test_near_duplicates_keep_unique_texts_of_repeated_ids(spark, drop):
    x, u, v, w = (prose(c) for c in "xuvw")
    rows = [(1, x), (5, x), (5, u), (9, v), (9, w), (None, x), (None, prose("n")), (None, prose("n")), (None, prose("m")), (9, w)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    left = drop(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([rows[i] for i in (0, 2, 3, 4, 6, 8)], key=str)


def sizes(rows):
    return sum(len(re.findall(WORD, r.text or "")) for r in rows)


def test_mixing_draws_rows_without_ids_each(spark):
    rows = [(None, " ".join(f"w{i}x{k}" for k in range(1 + i % 11)), "b") for i in range(1000)] + [(i, prose("a", 10), "a") for i in range(4000)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.mix(docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 11 for s in target)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    held = Counter()
    for r in mixed.collect():
        held[r.source] += len(r.text.split())
    assert held == taken


def test_mixing_draws_copies_of_one_row_each(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    one = prose("c", 10)
    rows = [(None, one, "b", i % 3) for i in range(900)] + [(1, one, "b", 0)] * 50 + [(i, prose("a", 10), "a", 0) for i in range(3000)] + [(None, None, None, 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 10 for s in target)
    mixed = [Counter(map(tuple, mixing.mixed_documents(d).collect())) for d in (docs, docs.repartition(6))]
    assert mixed[0] == mixed[1]
    assert Counter(r[2] for r in mixed[0].elements() if r[1]) == {s: n // 10 for s, n in taken.items() if n}
    start = Counter(rows)
    assert all(n <= 3 * start[r] for r, n in mixed[0].items())


@pytest.mark.parametrize("rows", [
    [(None, f"{i:01000d}") for i in range(100)],
    [(3, f"{i:01000d}") for i in range(100)],
    [(None, "c" * 1000)] * 100,
    [(4, "c" * 1000)] * 60 + [(4, "d" * 1000)] * 40 + [(5, "e" * 9000), (6, ""), (None, None)],
])
def test_no_shard_of_several_rows_exceeds_the_limit(spark, rows, tmp_path):
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    placed = sharding.assign(docs, 5000).collect()
    assert len(placed) == len(rows)
    size, count = Counter(), Counter()
    for r in placed:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
    for r in placed:
        assert (r.shard_bytes, r.shard_docs, r.depth) == (size[r.shard], count[r.shard], len(r.shard))
        assert r.oversize == (r.shard_bytes > 5000) and (not r.oversize or r.shard_docs == 1)
    assert not any(s != t and t.startswith(s) for s in size for t in size)
    whole = sharding.shard_documents(docs, 5000)
    assert whole.columns == [*docs.columns, "shard", "shard_bytes"]
    held = whole.collect()
    assert Counter((r.doc_id, r.text) for r in held) == Counter(rows)
    back = Counter()
    for r in held:
        back[r.shard] += len((r.text or "").encode())
    assert all(back[r.shard] == r.shard_bytes for r in held) and max(back.values()) <= 9000
    sharding.write_shards(whole.select("doc_id", "text", "shard"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("shard=*/*.parquet"))) == len(back)
