"""Golden rows, negative inputs and edge cases of the neighbour engine."""

import gzip
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quorumlake.functions.hashing import planes, probe_masks
from quorumlake.functions.packing import COORDINATES, pack, unpack
from quorumlake.functions.vectorize import vectorize
from quorumlake.operators import blocks, cells, decide, evaluate, knn, lsh
from quorumlake.plans import shared
from quorumlake.plans.config import Config, Normalization, load_config
from quorumlake.plans.load import load_from_environment
from quorumlake.sources import references, requests
from quorumlake.streaming import load, scoring

# The two published example vectors.
LEGIT = [float(x) for x in (0.01, 0.0833, 0.05, 0.8261, 0.1667, -1, -1, 0.0432, 0.25, 0, 1, 0, 0.2, 0.0416)]
FRAUD = [float(x) for x in (0.5796, 0.9167, 1, 0.0435, 0, 0.0056, 0.4394, 0.4598, 0.4, 1, 0, 1, 0.85, 0.0032)]


def body(**kw):
    base = {
        "id": "tx-1",
        "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
        "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]},
        "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
        "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23},
        "last_transaction": None,
    }
    for path, v in kw.items():
        at = base
        *head, tail = path.split("__")
        for h in head:
            at = at[h]
        at[tail] = v
    return json.dumps(base)


def vector(spark, *bodies, config=None):
    df = requests.parse_requests(spark.createDataFrame([(b,) for b in bodies], "value string")).select("request.*")
    return [[r[f"v{i}"] for i in range(14)] + [r.error] for r in vectorize(df, config).collect()]


def test_golden_vectors(spark):
    fraud = body(
        transaction={"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"},
        customer={"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008"]},
        merchant={"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86}, terminal={"is_online": False, "card_present": True, "km_from_home": 952.27},
    )
    clamp = body(
        transaction={"amount": 20000, "installments": 99, "requested_at": "2026-03-09T01:30:00+01:30"},
        customer={"avg_amount": 1, "tx_count_24h": 0, "known_merchants": None}, merchant={"id": "M", "mcc": "x", "avg_amount": 99999},
        terminal={}, last_transaction={"timestamp": "2026-03-08T22:30:00Z", "km_from_current": 5000},
    )
    got = vector(spark, body(), fraud, clamp, body(customer__avg_amount=0), '{"id":"x"}')
    assert got[0][:14] == pytest.approx([0.004112, 2 / 12, 0.05, 18 / 23, 2 / 6, -1, -1, 0.02923, 0.15, 0, 1, 0, 0.15, 0.006025], abs=1e-9)
    assert got[1][:14] == pytest.approx([0.950597, 10 / 12, 1, 5 / 23, 5 / 6, -1, -1, 0.95227, 1, 0, 1, 1, 0.75, 0.005486], abs=1e-9)
    assert got[2][:14] == pytest.approx([1, 1, 1, 0, 0, 90 / 1440, 1, 0, 0, 0, 0, 1, 0.5, 1], abs=1e-9)
    assert got[3][14] and got[4][14] and not got[0][14]
    assert got[4][3:5] == [0, 0]  # an absent instant is Monday, hour 0


def test_request_bodies(spark):
    bad = ["{", "{} {}", "{},{}", "[1]", "", "null", body(transaction__requested_at="2026-03-11"), body(transaction__requested_at="x"), '{"id":"' + "x" * (1 << 20) + '"}']
    bad += [body(**{k: v}) for k, v in [
        ("id", 1), ("id", []), ("transaction", 5), ("transaction__amount", "1.5"), ("transaction__amount", "NaN"), ("transaction__installments", 2.5), ("transaction__installments", 2.0), ("transaction__installments", True),
        ("transaction__requested_at", 5), ("customer", []), ("customer__tx_count_24h", "3"), ("customer__known_merchants", "x"), ("customer__known_merchants", [1]), ("customer__known_merchants", ["a", 1]), ("customer__known_merchants", {}),
        ("merchant__mcc", 5411), ("merchant__id", False), ("merchant__avg_amount", {}), ("terminal__is_online", "yes"), ("terminal__card_present", 1), ("terminal__km_from_home", "far"), ("last_transaction", 1), ("last_transaction", {"km_from_current": "x"}),
    ]]
    good = [body(transaction__amount=None, merchant__mcc=None), body(customer__known_merchants=["a", None]), body(customer__known_merchants=[]), body(transaction__installments=3_000_000_000), body(other={"x": [1, "a"]}), body(transaction__amount=5, terminal=None)]
    assert all(r.request is not None for r in requests.parse_requests(spark.createDataFrame([(b,) for b in good], "value string")).collect())
    rows = spark.createDataFrame([(b,) for b in [*bad, body(), body(last_transaction={}), None]], "value string")
    got = [r.request for r in requests.parse_requests(rows).collect()]
    assert got[: len(bad)] == [None] * len(bad) and got[-1] is None
    assert got[-3].last_transaction is None and got[-2].last_transaction is not None
    assert got[-3].customer.known_merchants == ["MERC-003", "MERC-016"]


@pytest.mark.parametrize("key", ["max_amount", "max_km", "max_minutes"])
def test_config(tmp_path, key):
    with pytest.raises(ValueError, match=key):
        Normalization(**{key: 0})
    for risk in ({"1": 1.1}, {"1": -0.1}, None):
        with pytest.raises(ValueError):
            Config(mcc_risk=risk)
    (tmp_path / "n.json").write_text(json.dumps({f: 1.0 for f in ("max_amount", "max_installments", "amount_vs_avg_ratio", "max_minutes", "max_km", "max_tx_count_24h", "max_merchant_avg_amount") if f != key}))
    (tmp_path / "m.json").write_text("{} {}")
    with pytest.raises(ValueError, match=f"{key} is missing"):
        load_config(str(tmp_path / "m.json"), str(tmp_path / "n.json"))


def test_reference_file(spark, tmp_path):
    rows = [{"vector": LEGIT, "label": "legit"}, {"vector": FRAUD, "label": "fraud"}]

    def read(text, fail=True):
        path = tmp_path / f"r{random.random()}.json.gz"
        path.write_bytes(gzip.compress(text.encode()))
        return references.validate(references.read_references(spark, str(path)), fail).orderBy("ref_id").collect()

    got = read(json.dumps(rows))
    assert [(r.ref_id, r.vector, r.label) for r in got] == [(0, LEGIT, "legit"), (1, FRAUD, "fraud")]
    spaced = " \n[ " + " ,\n ".join(json.dumps(x, indent=1) for x in rows * 50) + "\n ]\n"
    assert [r.ref_id for r in read(spaced)] == list(range(100)) and read("[]") == read(" [ ]\n") == []
    plain = tmp_path / "plain.json"
    plain.write_text(json.dumps(rows * 400))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = references.read_references(spark, str(plain))
    assert got.rdd.getNumPartitions() > 2 and [(r.ref_id, r.label) for r in got.orderBy("ref_id").collect()] == [(i, rows[i % 2]["label"]) for i in range(800)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for text in ("", "[,]", '[{"vector":[],"label":"x"},]', json.dumps(rows).replace("}, {", "} {"), json.dumps(rows)[:-1], "x" + json.dumps(rows), json.dumps([1]), json.dumps(rows[0]), json.dumps(rows) + "[]", json.dumps(rows) + ",[]", "[", '[{"vector":[1,2],"label":"fraud"}]', '[{"vector":%s,"label":"x"}]' % LEGIT, '[{"label":"fraud"}]'):
        with pytest.raises(PySparkException):
            read(text)
    with pytest.raises(PySparkException):
        references.read_references(spark, str(tmp_path / "none.json.gz")).collect()
    bad = spark.createDataFrame([(0, [*LEGIT[:5], 0.5, -1.0, *LEGIT[7:]], "legit"), (1, [-1.0, *LEGIT[1:]], "legit"), (2, [float("nan"), *LEGIT[1:]], "legit"), (3, None, "fraud"), (4, [None, *LEGIT[1:]], "fraud"), (5, [*LEGIT, 0.0], "fraud"), (6, LEGIT, None)], "ref_id long, vector array<double>, label string")
    assert [r.problem for r in references.validate(bad, fail=False).orderBy("ref_id").collect()] == [None, "values", "values", "dimensions", None, "dimensions", "label"]
    store = references.pack(spark.createDataFrame([(i, x["vector"], x["label"]) for i, x in enumerate(rows)], "ref_id long, vector array<double>, label string"))
    references.write_store(store, str(tmp_path / "store"))
    back = references.read_store(spark, str(tmp_path / "store"))
    assert references.point(back, 1).count() == 1 and references.point(back, 9).count() == 0
    for r in references.export(back).collect():
        assert r.vector == pytest.approx(rows[r.ref_id]["vector"], abs=1 / 65534) and r.label == rows[r.ref_id]["label"]


def test_dataset_load(spark, tmp_path, monkeypatch):
    rows = [{"vector": LEGIT, "label": "legit"}, {"vector": FRAUD, "label": "fraud"}]
    (tmp_path / "references.json.gz").write_bytes(gzip.compress(json.dumps(rows).encode()))
    (tmp_path / "mcc_risk.json").write_text('{"5411": 0.15}')
    (tmp_path / "normalization.json").write_text(json.dumps({f: 1.0 for f in ("max_amount", "max_installments", "amount_vs_avg_ratio", "max_minutes", "max_km", "max_tx_count_24h", "max_merchant_avg_amount")}))
    got = load_from_environment(spark, str(tmp_path))
    assert got.store.count() == 2 and got.config.mcc_risk == {"5411": 0.15}
    bad = tmp_path / "bad.json.gz"
    bad.write_bytes(gzip.compress(json.dumps([*rows, {"vector": LEGIT, "label": "other"}]).encode()))
    monkeypatch.setenv("REFERENCES_PATH", str(bad))
    with pytest.raises(PySparkException, match="reference 2: invalid label"):
        load_from_environment(spark, str(tmp_path))
    monkeypatch.setenv("MCC_RISK_PATH", str(tmp_path / "none.json"))
    with pytest.raises(FileNotFoundError):
        load_from_environment(spark, str(tmp_path))


def test_packing(spark):
    values = [0.123456, 0.5, 1.0, 0.0, 0.75, -1.0, 0.49999999999999994]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", pack(F.col("v")).alias("c")).select("v", "c", unpack(F.col("c")).alias("u"))
    for r in df.collect():
        assert abs(r.v - r.u) <= 1 / 65534 and (r.v != -1 or r.c == -65534)


def rows_of(spark, vectors, name, labels=None):
    data = [(i, *[-65534 if v == -1 else round(v * 65534) for v in vec], int(labels[i]) if labels else 0) for i, vec in enumerate(vectors)]
    df = spark.createDataFrame(data, f"{name} long, {', '.join(f'{c} long' for c in COORDINATES)}, fraud int")
    return df if labels else df.drop("fraud")


def generated(spark, seed=11):
    """Random vectors on a coarse grid, so that many distances tie; sentinels where they are allowed."""
    r = random.Random(seed)
    vectors = [[-1 if d in (5, 6) and r.random() < 0.3 else r.randrange(5) / 4 if d < 9 else r.randrange(2) for d in range(14)] for _ in range(150)]
    refs = vectors[:130] + r.sample(vectors[:130], 10)  # some of them twice
    return rows_of(spark, refs, "ref_id", [r.random() < 0.4 for _ in refs]), rows_of(spark, vectors[130:], "query_id")


def brute(refs, ask, k):
    """The k nearest by plain Python, ties to the smaller id."""
    out = []
    for q in ask.collect():
        key = lambda r: sum((r[c] - q[c]) ** 2 for c in COORDINATES)  # noqa: B023, E731
        near = sorted((key(r), r.ref_id, r.fraud) for r in refs.collect())[:k]
        out += [(q.query_id, i + 1, ref, d, fraud) for i, (d, ref, fraud) in enumerate(near)]
    return sorted(out)


def as_set(df):
    return sorted((r.query_id, r["rank"], r.ref_id, r.distance_key, r.fraud) for r in df.collect())


def test_all_exact_plans_agree(spark):
    refs, ask = generated(spark)
    index = cells.build(refs, levels=4)
    assert [r.n for r in index.boxes.orderBy("cell").collect()] == index.size.tolist() and index.size.sum() == 140
    for k in (1, 5, 200):
        want = brute(refs, ask, k)
        assert len(want) == 20 * min(k, 140)
        assert as_set(knn.knn_sql(ask, refs, k)) == want
        assert as_set(knn.knn_arrow(ask, refs.repartition(5), k)) == want
        assert as_set(cells.knn_cells(ask, index, k)) == want
        assert as_set(lsh.knn_lsh(ask, lsh.index(refs), k, radius=20)) == want  # all buckets are everything
    assert as_set(cells.knn_cells_budget(ask, index, 5, cells=16)) == brute(refs, ask, 5)
    few = cells.knn_cells_budget(ask, index, 5, cells=2)
    assert few.count() <= 100 and {(r.query_id, r.ref_id, r.distance_key) for r in few.collect()} <= {(q, i, d) for q, _, i, d, _ in brute(refs, ask, 200)}


def test_plans_over_arrays_and_doubles(spark):
    refs, ask = generated(spark, 12)
    label = F.when(F.col("fraud") == 1, 1).otherwise(0).alias("label")
    nested = knn.knn_arrays(ask.select("query_id", F.array(*COORDINATES).alias("coords")), refs.select("ref_id", F.array(*COORDINATES).alias("coords"), label), 5)
    assert sorted((r.query_id, r["rank"], r.ref_id, r.distance_key, r.label) for r in nested.collect()) == brute(refs, ask, 5)
    doubles = [F.col(c).cast("double").alias(v) for c, v in zip(COORDINATES, knn.FLOATS, strict=True)]
    floats = knn.knn_float(ask.select("query_id", *doubles), refs.select("ref_id", *doubles, "fraud"), 5)
    assert sorted((r.query_id, r["rank"], r.ref_id, int(r.distance_key), r.fraud) for r in floats.collect()) == brute(refs, ask, 5)


def test_query_blocks(spark, monkeypatch):
    refs, ask = generated(spark)
    want = brute(refs, ask, 5)
    index = cells.build(refs, levels=3)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 6)
    monkeypatch.setattr(blocks, "TILE", 4)
    assert as_set(knn.knn_arrow(ask, refs, 5)) == as_set(cells.knn_cells(ask, index, 5)) == want
    assert as_set(knn.knn_arrow(ask.limit(0), refs, 5)) == []
    sql = knn.knn_sql(ask, refs, 5)
    assert as_set(sql) == want and "CartesianProduct" not in sql._jdf.queryExecution().toString()


def test_block_search_sorts_only_what_tasks_send(spark):
    refs, ask = generated(spark)
    plan = knn.knn_arrow(ask, refs, 5)._jdf.queryExecution().toString()
    assert "Sort" not in plan and "Join" not in plan  # the answers are a table by then


def test_index_is_kept_on_disk(spark, tmp_path):
    refs, ask = generated(spark)
    cells.build(refs, levels=4, path=str(tmp_path / "cells"))
    lsh.build(refs, str(tmp_path / "hashes"))
    index = cells.open_index(spark, str(tmp_path / "cells"))
    assert as_set(cells.knn_cells(ask, index, 5)) == brute(refs, ask, 5)
    radius = {q: d for q, i, _, d, _ in brute(refs, ask, 5) if i == 5}
    seen = {r.query_id: r.visited for r in cells.visited_rows(ask, index, 5).collect()}
    assert seen.keys() == radius.keys() and all(5 <= n <= 140 for n in seen.values())
    back = spark.read.parquet(str(tmp_path / "hashes"))
    assert back.count() == 140 and {"sig0", "sig1", "coarse", "projection"} <= set(back.columns)
    empty = cells.build(refs.limit(0), levels=3)
    assert cells.knn_cells(ask, empty, 5).count() == cells.knn_cells_budget(ask, empty, 5, 2).count() == lsh.knn_lsh(ask, lsh.index(refs.limit(0)), 5).count() == 0


def test_splits_are_medians_of_all_rows(spark):
    refs, ask = generated(spark)
    index = cells.build(refs, levels=3, sample=10)
    groups = [sorted(tuple(r[c] for c in COORDINATES) for r in refs.collect())]
    for d in range(3):
        cuts = [sorted(g[d] for g in rows)[(len(rows) - 1) // 2] if rows else 0 for rows in groups]
        groups = [[x for x in rows if (x[d] > cut) == side] for rows, cut in zip(groups, cuts, strict=True) for side in (False, True)]
    assert {r.cell: r.n for r in index.boxes.collect()} == {i: len(rows) for i, rows in enumerate(groups) if rows}
    assert as_set(cells.knn_cells(ask, index, 5)) == brute(refs, ask, 5)


def test_order_ties_and_sentinels(spark):
    refs = rows_of(spark, [[0] * d + [v] + [0] * (13 - d) for d, v in ((3, 0.9), (0, 0.25), (8, 0.25), (1, 0.75), (13, 0.05))], "ref_id", [0, 1, 0, 1, 0])
    zero = rows_of(spark, [[0] * 14], "query_id")
    got = knn.with_distance(knn.knn_arrow(zero, refs, 4)).orderBy("rank").collect()
    assert [r.ref_id for r in got] == [4, 1, 2, 3] and [r.distance for r in got] == pytest.approx([0.05, 0.25, 0.25, 0.75], abs=1e-4)
    both = rows_of(spark, [[0] * 5 + [-1, -1] + [0] * 7], "ref_id", [0])
    assert knn.knn_arrow(zero, both, 5).collect()[0].distance_key == 2 * 65534**2
    assert knn.knn_arrow(zero, refs.limit(0), 5).count() == 0
    index = cells.build(refs, levels=2)
    for f, r in ((knn.knn_sql, refs), (knn.knn_arrow, refs), (cells.knn_cells, index), (lsh.knn_lsh, lsh.index(refs))):
        with pytest.raises(ValueError):
            f(zero, r, 0)
    with pytest.raises(ValueError):
        cells.knn_cells_budget(zero, index, 5, cells=0)
    for wrong in ({"radius": 21}, {"enough": 4}):
        with pytest.raises(ValueError):
            lsh.knn_lsh(zero, lsh.index(refs), 5, **wrong)
    for given in ((None, refs), (zero, None)):
        with pytest.raises(ValueError):
            decide.score(*given)


def test_hashing_parameters():
    assert [len(probe_masks(r)) for r in range(4)] == [1, 21, 211, 1351]
    with pytest.raises(ValueError):
        probe_masks(4)
    assert len(planes(1)) == 20 and planes(1)[0][0] == -1  # first state 1120982980


def test_hash_search(spark):
    refs, _ = generated(spark)
    ask = refs.where("ref_id % 10 = 0").withColumnRenamed("ref_id", "query_id").drop("fraud")
    for enough in (None, 5, 40):
        got = lsh.knn_lsh(ask, lsh.index(refs).repartition(3), 5, radius=3, enough=enough).collect()
        assert len({(r.query_id, r.ref_id) for r in got}) == len(got)
        assert {r.query_id for r in got if r["rank"] == 1 and r.distance_key == 0} == {r.query_id for r in got}
    with pytest.raises(ValueError):
        lsh.candidate_counts(ask, refs, cap=-1)


def test_rank_windows(spark):
    """Ranks and windows by ranges against plain Python, in one large and some small buckets."""
    r = random.Random(5)
    rows = [(i, r.choice([1, 1, 1, 1, 2, 3]), r.randrange(-90_000, 90_000) // 7 * 7) for i in range(600)]
    asked = [(1000 + i, 0, r.choice([1, 2, 3, 4]), r.randrange(-99_000, 99_000)) for i in range(40)]
    refs = spark.createDataFrame(rows, "ref_id long, bucket long, projection long")
    ranked = lsh.bucket_ranks(refs, "bucket")
    order = {}
    for i, b, p in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        order.setdefault(b, []).append((p, i))
    assert {(x.ref_id, x.rk, x.bucket_n) for x in ranked.collect()} == {(i, n + 1, len(v)) for v in order.values() for n, (_, i) in enumerate(v)}
    probes = spark.createDataFrame(asked, "query_id long, ordinal int, key long, q_projection long")
    for cap in (4, 30, 1000):
        want = set()
        for q, _, b, p in asked:
            v = order.get(b, [])
            low = max(0, sum(x < p for x, _ in v) - cap // 2)
            end = min(len(v), low + cap)
            low = max(0, len(v) - cap) if low + cap > len(v) else low
            want |= {(q, i) for _, i in v[low:end]}
        got = [(x.query_id, x.ref_id) for x in lsh.window_of(probes, ranked, "bucket", cap).collect()]
        assert set(got) == want and len(got) == len(want)


def test_decide(spark):
    rows = [(q, i, int(i < n)) for q, n in enumerate((0, 2, 3, 5)) for i in range(5)] + [(9, i, 0) for i in range(4)]
    got = {r.query_id: r for r in decide.decide(spark.createDataFrame(rows, "query_id long, ref_id long, fraud int")).collect()}
    assert [(got[q].fraud_score, got[q].approved) for q in range(4)] == [(0.0, True), (0.4, True), (0.6, False), (1.0, False)]
    assert got[9].error and got[9].approved is None


def test_scoring_keeps_error_rows(spark, tmp_path):
    refs, _ = generated(spark)
    bodies = spark.createDataFrame([(body(),), ("{",), (body(id="z", customer__avg_amount=0),)], "value string")
    got = sorted((r.status_code, r.error_stage, r.body) for r in scoring.score_bodies(bodies, refs).collect())
    assert [g[0] for g in got] == [200, 400, 500] and got[1][1] == "decode" and got[2][1] == "vectorize request"
    assert set(json.loads(got[0][2])) == {"approved", "fraud_score"}
    few = scoring.score_bodies(bodies.limit(1), refs.limit(3)).collect()
    assert few[0].status_code == 500 and few[0].error_stage == "decide"

    def broken(*_):
        raise ValueError("no index")

    parsed = requests.parse_requests(bodies.selectExpr("value", "monotonically_increasing_id() AS query_id")).where("request IS NOT NULL").select("query_id", "request.*")
    lost = sorted((r.error_stage, r.error) for r in decide.score(parsed, refs, search=broken).collect())
    assert [x[0] for x in lost] == ["search nearest neighbors", "vectorize request"] and "no index" in lost[0][1]
    other = decide.score(parsed, refs, vectorizer=lambda df, c, keep: vectorize(df, Config(mcc_risk={}), keep))
    assert sorted(r.status_code for r in other.collect()) == [200, 500]


def test_golden_scores(spark):
    # fixed values: the published example rows
    rows = [(0, 0, 0, 1.0), (5, 5, 0, 3.0), (0, 0, 0, 100.0), (30, 20, 0, 10.0), (100, 50, 0, 300.0), (500, 250, 0, 200.0), (500, 300, 0, 10.0), (0, 0, 5000, 60000.0)]
    want = [(3000, 3000, 6000), (2522.88, 2001.27, 4524.15), (1000, 3000, 4000), (2000, 1157.02, 3157.02), (522.88, 581.13, 1104.01), (698.97, -327.12, 371.85), (2000, -3000, -1000), (-3000, -3000, -6000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, fp long, fn long, err long, p99 double").withColumn("n", F.lit(5000))
    got = evaluate.with_scores(df).orderBy("i").collect()
    assert [(r.p99_score, r.detection_score, r.final_score) for r in got] == [pytest.approx(w, abs=0.01) for w in want]
    doc = spark.createDataFrame([(1735, 3210, 40, 15, 0, 5000, 5.81)], "tp long, tn long, fp long, fn long, err long, n long, p99 double")
    rows = doc.unionByName(doc.withColumn("p99", F.lit(60000.0)).withColumn("err", F.lit(900).cast("long")))
    made = [json.loads(r.result) for r in evaluate.report(evaluate.with_scores(rows).withColumns({"total": F.col("n"), "fraud_count": F.lit(1750)})).collect()]
    assert made[0]["expected"] == {"total": 5000, "fraud_count": 1750, "fraud_rate": 35.0} and made[0]["p99"] == "5.81" and made[1]["p99"] == "60000.00"
    assert made[1]["scoring"]["detection_score"] == {"value": -3000.0, "rate_component": None, "absolute_penalty": None, "cut_triggered": True}
    out = made[0]["scoring"]
    assert out["weighted_errors_E"] == 85 and out["failure_rate"] == "1.10%" and out["final_score"] == pytest.approx(3425.03, abs=0.02)
    assert out["detection_score"]["rate_component"] == pytest.approx(1769.55, abs=0.01) and out["p99_score"]["cut_triggered"] is False


def test_percentiles_and_sampling(spark):
    n = spark.range(1, 201).select(F.col("id").cast("double").alias("x"))
    assert tuple(evaluate.at_places(n, "x", {"a": evaluate.nearest_rank(95), "b": evaluate.nearest_rank(99), "c": evaluate.floor_index(95)}).collect()[0]) == (190, 198, 191)
    r = random.Random(2)
    values = [r.choice([r.random(), 0.25, 0.25, None]) for _ in range(3000)]
    held = sorted(v for v in values if v is not None)
    for p in (1, 50, 99, 100):
        got = evaluate.at_places(spark.createDataFrame([(v,) for v in values], "x double").repartition(3), "x", {"r": evaluate.nearest_rank(p)}).collect()[0].r
        assert got == held[-(-len(held) * p // 100) - 1]
    assert evaluate.at_places(n.limit(0), "x", {"r": evaluate.nearest_rank(50)}).collect()[0].r is None
    for total, limit in ((10, 3), (10, 10), (10, 0), (7, 6), (1000, 37)):
        got = sorted(r.id for r in requests.systematic_sample(spark.range(total), "id", limit).collect())
        assert got == sorted({j * total // limit for j in range(limit)} if 0 < limit < total else range(total))
    empty = evaluate.mismatch(spark.createDataFrame([], "expected_approved boolean, approved boolean, failed boolean")).collect()[0]
    assert (empty.mismatches, empty.total, empty.mismatches_percent) == (0, 0, 0.0)


def test_labelled_file(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"entries": [{"request": json.loads(body()), "expected_approved": True}, {"request": json.loads(body(id="b")), "expected_approved": False}]}))
    rows = requests.read_labelled(spark, str(tmp_path / "t.json")).orderBy("position").collect()
    assert [(r.position, r.request.id, r.expected_approved) for r in rows] == [(0, "tx-1", True), (1, "b", False)]


def test_recall_of_approximate_plans(spark):
    from quorumlake.plans import queries

    sf = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.ref_id) for r in queries.knn_exact_packed(spark, sf).collect()}
    for plan in (queries.knn_cells_budget, queries.lsh_staged_knn):
        near = {(r.query_id, r.ref_id) for r in plan(spark, sf).collect()}
        assert len(exact & near) >= 0.9 * len(exact), plan.__name__


def test_cancelling(spark):
    import threading

    from quorumlake.plans.jobs import cancel, job_group

    seen = []

    def slow():
        with job_group(spark, "slow-search"):
            try:
                spark.range(1 << 40).selectExpr("sum(id * id % 7)").collect()
            except Exception as e:  # the cancelled job's error
                seen.append(str(e))

    t = threading.Thread(target=slow)
    t.start()
    for _ in range(60):
        cancel(spark, "slow-search")
        t.join(1)
        if not t.is_alive():
            break
    assert not t.is_alive() and seen


def test_stream_stops(spark, tmp_path):
    refs, _ = generated(spark)
    (tmp_path / "in").mkdir()
    run = scoring.start(scoring.read_bodies(spark, str(tmp_path / "in")), refs, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert scoring.ready(run)
    scoring.stop(run, 1)
    assert not scoring.ready(run)


def test_load_client(spark):
    refs, _ = generated(spark)

    def call(text):
        if text == "lost":
            raise OSError("no connection")
        row = scoring.score_bodies(spark.createDataFrame([(text,)], "value string"), refs).collect()[0]
        return load.Answer(row.status_code, "a")

    samples, seconds = load.run_load(spark, call, [body(), "lost", "{", body(id="2")], callers=2)
    total, instances = load.summary(samples, seconds)
    row = total.collect()[0]
    assert (row.ok, row.errors, row.total) == (2, 2, 4) and row.min_ms <= row.p50 <= row.p99 <= row.max_ms and row.throughput == pytest.approx(4 / seconds)
    assert [tuple(r) for r in instances.collect()] == [("a", 2)]
    with pytest.raises(ValueError):
        load.run_load(spark, call, [], callers=0)


def test_stream_leaves_no_tables_behind(spark, tmp_path, monkeypatch):
    refs, _ = generated(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "scratch").mkdir()
    monkeypatch.setattr(shared, "scratch", lambda _: str(tmp_path / "scratch"))
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(body(id=str(i)) + "\n{\n")
    run = scoring.start(scoring.read_bodies(spark, str(tmp_path / "in"), 1), refs, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.batch, r.id or "", r.status_code) for r in got.collect()) == [(0, "", 400), (0, "0", 200), (1, "", 400), (1, "1", 200)]
    assert list((tmp_path / "scratch").iterdir()) == []
