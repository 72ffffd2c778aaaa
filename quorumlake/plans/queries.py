"""The registered queries of the neighbour engine and the same in DuckDB SQL.

Searches take as queries every row whose id is divisible by 100, against all other rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import BITS, SEEDS, WEIGHTS, coarse_cell, planes, probe_masks, projection, signature
from ..functions.packing import COORDINATES, SCALE, is_fraud, pack, unpack
from ..functions.vectorize import vectorize
from ..operators import cells, decide, evaluate, knn, lsh
from ..sources import adapters, references, requests
from ..streaming import scoring
from .config import Config
from .shared import fresh

Query = Callable[[SparkSession, str], DataFrame]
V = [f"v{i}" for i in range(14)]
K = 5
EVERY = 100
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---------------------------------------------------------------- shared inputs


def all_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.requests_from_events(adapters.events(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize(all_requests(spark, sf_dir), Config(), ("event_id", "label"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, c0..c13, fraud) of all rows."""
    v = vectors(spark, sf_dir).where("error IS NULL")
    return v.select(F.col("event_id").alias("ref_id"), *[pack(F.col(a)).alias(b) for a, b in zip(V, COORDINATES, strict=True)], is_fraud(F.col("label")).alias("fraud"))


def query_rows(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("ref_id") % EVERY == 0).select(F.col("ref_id").alias("query_id"), *COORDINATES)


_BUILT: dict[tuple, object] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, make: Callable[[], object]) -> object:
    """What ``make`` builds of the events table, built once an application and set of files."""
    key = (kind, spark.sparkContext.applicationId, tuple(sorted(adapters.events(spark, sf_dir).inputFiles())))
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows as a Parquet store: built once, scanned by queries and references alike."""

    def make() -> DataFrame:
        path = fresh(spark, "packed")
        references.write_store(packed(spark, sf_dir), path)
        return references.read_store(spark, path)

    return _once("packed", spark, sf_dir, make)


def cell_index(spark: SparkSession, sf_dir: str) -> cells.CellIndex:
    return _once("cells", spark, sf_dir, lambda: cells.build(stored(spark, sf_dir)))


def hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("hashes", spark, sf_dir, lambda: lsh.build(stored(spark, sf_dir)))


_RISK = "CASE mcc " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in Config().mcc_risk.items()) + " ELSE 0.5::DOUBLE END"


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0::DOUBLE), 1::DOUBLE)"


_DIMS = [
    _clamp("amount / 10000.0::DOUBLE"),
    _clamp("installments::DOUBLE / 12.0::DOUBLE"),
    _clamp("amount / avg_amount / 10.0::DOUBLE"),
    "extract(hour FROM ts)::DOUBLE / 23.0::DOUBLE",
    "(isodow(ts) - 1)::DOUBLE / 6.0::DOUBLE",
    f"CASE WHEN last_ts IS NULL THEN -1::DOUBLE ELSE {_clamp('(epoch_us(ts) - epoch_us(last_ts))::DOUBLE / 60000000.0::DOUBLE / 1440.0::DOUBLE')} END",
    f"CASE WHEN last_ts IS NULL THEN -1::DOUBLE ELSE {_clamp('km_last / 1000.0::DOUBLE')} END",
    _clamp("km_home / 1000.0::DOUBLE"),
    _clamp("tx_count_24h::DOUBLE / 20.0::DOUBLE"),
    "is_online::INT::DOUBLE",
    "card_present::INT::DOUBLE",
    "CASE WHEN list_contains(known, merchant_id) THEN 0::DOUBLE ELSE 1::DOUBLE END",
    _RISK,
    _clamp("merchant_avg / 10000.0::DOUBLE"),
]
_REQ = f"WITH {adapters.REQUEST_SQL}"
_VEC = f"{_REQ}, vec AS (SELECT event_id, label, {', '.join(f'{d} AS v{i}' for i, d in enumerate(_DIMS))} FROM req WHERE avg_amount <> 0)"
_PACK = f"{_VEC}, pk AS (SELECT event_id AS ref_id, (label = 'fraud')::INT AS fraud, {', '.join(f'CASE WHEN v{i} = -1 THEN -{SCALE} ELSE round(v{i} * {SCALE})::BIGINT END AS c{i}' for i in range(14))} FROM vec)"
_KEY = " + ".join(f"(q.c{i} - r.c{i}) * (q.c{i} - r.c{i})" for i in range(14))
_FLOAT_KEY = " + ".join(f"(q.v{i} - r.v{i}) * (q.v{i} - r.v{i})" for i in range(14))
_PAIRS = f"{_PACK}, pairs AS (SELECT q.ref_id AS query_id, r.ref_id, r.fraud, {_KEY} AS distance_key FROM pk q JOIN pk r ON q.ref_id <> r.ref_id WHERE q.ref_id % {EVERY} = 0)"


def _top(k: int) -> str:
    return f"{_PAIRS}, nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance_key, ref_id) AS rank FROM pairs) WHERE rank <= {k})"


_NN = _top(K)
_NN_COLUMNS = f"query_id, rank::INT AS rank, ref_id, distance_key, sqrt(distance_key::DOUBLE / ({float(SCALE)}::DOUBLE * {SCALE})) AS distance, fraud"
_NN_SQL = f"{_NN} SELECT {_NN_COLUMNS} FROM nn"
_DECIDE = f"{_NN}, dec AS (SELECT query_id, count(*) AS neighbors, sum(fraud)::INT AS fraud_count, sum(fraud)::DOUBLE / 5.0::DOUBLE AS fraud_score FROM nn GROUP BY query_id)"


def _found(df: DataFrame) -> DataFrame:
    return knn.with_distance(df).select("query_id", "rank", "ref_id", "distance_key", "distance", "fraud")


# ---------------------------------------------------------------- projections


@query(f"{_VEC} SELECT event_id, {', '.join(V)}, label FROM vec")
def vectorize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("error IS NULL").select("event_id", *V, "label")


@query(f"{_VEC} SELECT {', '.join(f'min(v{i}) AS min{i}, max(v{i}) AS max{i}' for i in range(14))} FROM vec")
def vectorize_clamp_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).where("error IS NULL")
    return v.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(14) for n, f in (("min", F.min), ("max", F.max))])


@query("SELECT event_id, extract(hour FROM ts)::DOUBLE / 23.0::DOUBLE AS hour_of_day, (isodow(ts) - 1)::DOUBLE / 6.0::DOUBLE AS day_of_week FROM events")
def hour_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events(spark, sf_dir).select("event_id", (F.hour("ts") / 23.0).alias("hour_of_day"), (F.weekday("ts") / 6.0).alias("day_of_week"))


@query(f"{_REQ} SELECT event_id, {_DIMS[5]} AS minutes_since_last, {_DIMS[6]} AS km_from_last, {_DIMS[8]} AS tx_count_24h FROM req")
def last_tx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("event_id", F.col("v5").alias("minutes_since_last"), F.col("v6").alias("km_from_last"), F.col("v8").alias("tx_count_24h"))


@query(f"{_REQ} SELECT event_id, mcc, {_RISK} AS risk FROM req")
def mcc_risk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a left join to the (broadcast, ten-row) risk table with a default."""
    risk = spark.createDataFrame(list(Config().mcc_risk.items()), "k string, r double")
    rows = all_requests(spark, sf_dir).select("event_id", "merchant.mcc")
    return rows.join(F.broadcast(risk), F.col("mcc") == F.col("k"), "left").select("event_id", "mcc", F.coalesce("r", F.lit(0.5)).alias("risk"))


@query(f"{_REQ} SELECT event_id, merchant_id, NOT list_contains(known, merchant_id) AS is_unknown FROM req")
def known_merchant_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_requests(spark, sf_dir).select("event_id", F.col("merchant.id").alias("merchant_id"), (~F.array_contains("customer.known_merchants", F.col("merchant.id"))).alias("is_unknown"))


@query(f"{_PACK} SELECT * FROM pk")
def pack_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir)


@query(f"{_PACK} SELECT ref_id, {', '.join(f'CASE WHEN c{i} < 0 THEN -1::DOUBLE ELSE c{i}::DOUBLE / {SCALE}::DOUBLE END AS v{i}' for i in range(14))} FROM pk")
def unpack_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("ref_id", *[unpack(F.col(c)).alias(v) for c, v in zip(COORDINATES, V, strict=True)])


# ---------------------------------------------------------------- validation and sources

_BROKEN = "CASE WHEN event_id % 97 = 0 THEN 1.5::DOUBLE WHEN event_id % 89 = 0 THEN -1::DOUBLE ELSE v0 END"


@query(
    f"{_VEC}, b AS (SELECT CASE WHEN event_id % 83 = 0 THEN 'dimensions' WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN 'values' WHEN event_id % 79 = 0 THEN 'label' ELSE 'valid' END AS problem FROM vec) "
    "SELECT problem, count(*) AS n FROM b GROUP BY 1"
)
def validate_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by rule over all vectors, some of them broken in known ways."""
    e, v = F.col("event_id"), F.array(*[F.col(x) for x in V[1:]])
    first = F.when(e % 97 == 0, 1.5).when(e % 89 == 0, -1.0).otherwise(F.col("v0"))
    whole = F.when(e % 83 == 0, v).otherwise(F.concat(F.array(first), v))
    rows = vectors(spark, sf_dir).where("error IS NULL").select(e.alias("ref_id"), whole.alias("vector"), F.when(e % 79 == 0, "unknown").otherwise(F.col("label")).alias("label"))
    checked = references.validate(rows, fail=False)
    return checked.groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"{_REQ} SELECT CASE WHEN event_id % 11 = 0 THEN 500 ELSE 200 END AS status_code, count(*) AS n FROM req GROUP BY 1")
def error_channel_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer average of zero is an error row and doesn't end the query."""
    rows = all_requests(spark, sf_dir).withColumn("customer", F.when(F.col("event_id") % 11 == 0, F.col("customer").withField("avg_amount", F.lit(0.0))).otherwise(F.col("customer")))
    v = vectorize(rows, Config(), ("event_id",))
    return v.groupBy(F.when(F.col("error").isNull(), 200).otherwise(500).alias("status_code")).agg(F.count("*").alias("n"))


#: What is wrong with the body of an event, by event_id % 17; 0 and others are right.
_WRONG = {
    1: "{", 2: None, 3: '"installments":2.5', 4: '"amount":"abc"', 5: '"installments":"2"', 6: '"requested_at":5', 7: '"requested_at":"2026-03-11"',
    8: '"is_online":"yes"', 9: '"known_merchants":"x"', 10: '"mcc":5411', 11: '"known_merchants":[1]', 12: '"merchant":[]', 13: '"id":7',
}


@query(
    f"SELECT event_id, CASE WHEN event_id % 17 BETWEEN 1 AND {max(_WRONG)} THEN 400 ELSE 200 END AS status_code, CASE WHEN event_id % 17 NOT BETWEEN 1 AND {max(_WRONG)} THEN value * 60 END AS amount, "
    f"CASE WHEN event_id % 17 NOT BETWEEN 1 AND {max(_WRONG)} THEN event_id % 4 <> 0 AND event_id % 3 = 0 END AS has_last FROM events"
)
def json_request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies: truncated and trailing ones and every wrong type are rejected, ``{}`` differs from null, unknown fields don't matter."""
    e, kind = F.col("event_id"), F.col("event_id") % 17
    last = F.when((e % 4 != 0) & (e % 3 == 0), '"last_transaction":{}').otherwise('"last_transaction":null')
    given = lambda *kinds: F.concat(*[F.when(kind == k, "," + _WRONG[k]).otherwise("") for k in kinds])
    merchant = F.when(kind == 12, _WRONG[12]).otherwise(F.concat(F.lit('"merchant":{"id":"MERC-001"'), given(10), F.lit("}")))
    body = F.concat(
        F.lit("{"), F.when(kind == 13, _WRONG[13]).otherwise(F.concat(F.lit('"id":"'), e.cast("string"), F.lit('"'))),
        F.lit(',"transaction":{"other":[1],"amount":'), F.when(kind == 4, '"abc"').otherwise((F.col("value") * 60).cast("string")),
        F.when(kind.isin(3, 5), "").otherwise(',"installments":1'), F.when(kind.isin(6, 7), "").otherwise(',"requested_at":"2026-03-11T20:23:35Z"'), given(3, 5, 6, 7),
        F.lit('},"customer":{"avg_amount":1'), given(9, 11), F.lit('},"terminal":{"km_from_home":null'), given(8), F.lit("},"), merchant, F.lit(","), last, F.lit("}"),
    )
    bodies = adapters.events(spark, sf_dir).select("event_id", F.when(kind == 1, F.lit("{")).when(kind == 2, F.concat(body, F.lit(" {}"))).otherwise(body).alias("value"))
    r = requests.parse_requests(bodies)
    good = F.col("request").isNotNull()
    return r.select("event_id", F.when(good, 200).otherwise(400).alias("status_code"), F.col("request.transaction.amount").alias("amount"), F.when(good, F.col("request.last_transaction").isNotNull()).alias("has_last"))


@query(f"{_PACK} SELECT count(*) AS n, sum(fraud)::BIGINT AS frauds FROM pk")
def store_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("fraud").alias("frauds"))


@query(f"{_PACK} SELECT * FROM pk")
def ingest_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed store and both indexes, built once; every search reads them."""
    cell_index(spark, sf_dir)
    hash_index(spark, sf_dir)
    return stored(spark, sf_dir)


_DECODED = ", ".join(f"CASE WHEN c{i} < 0 THEN -1::DOUBLE ELSE c{i}::DOUBLE / {SCALE}::DOUBLE END" for i in range(14))


def _as_columns(refs: DataFrame) -> DataFrame:
    return refs.select("ref_id", *[F.col("vector")[i].alias(v) for i, v in enumerate(V)], "label")


@query(f"{_PACK} SELECT ref_id, {', '.join(f'{d} AS v{i}' for i, d in enumerate(_DECODED.split(', ')))}, CASE WHEN fraud = 1 THEN 'fraud' ELSE 'legit' END AS label FROM pk")
def references_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references written as one gzip JSON array, loaded with their configuration, and exported again."""
    root = fresh(spark, "dataset")
    v = vectors(spark, sf_dir).where("error IS NULL")
    references.write_json_array(v.select(F.col("event_id").alias("ref_id"), F.array(*V).alias("vector"), "label"), f"{root}/references")
    made = references.pack(references.validate(references.read_references(spark, f"{root}/references")))
    ids = v.agg(F.min("event_id")).first()[0]  # places count from 0
    return _as_columns(references.export(made.withColumn("ref_id", F.col("ref_id") + ids)))


@query(f"{_PACK} SELECT ref_id, {', '.join(f'{d} AS v{i}' for i, d in enumerate(_DECODED.split(', ')))}, CASE WHEN fraud = 1 THEN 'fraud' ELSE 'legit' END AS label FROM pk WHERE ref_id = 42")
def point_lookup_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_columns(references.export(references.point(stored(spark, sf_dir), 42)))


@query(f"{_PACK} SELECT * FROM pk WHERE ref_id = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.point(stored(spark, sf_dir), 42)


@query("SELECT event_id FROM (SELECT event_id, count(*) OVER () AS n FROM events) WHERE list_contains(list_transform(range(0, 300), lambda j: j * n // 300), event_id) OR n <= 300")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = adapters.events(spark, sf_dir).select("event_id")
    return requests.systematic_sample(ev, "event_id", 300)


# ---------------------------------------------------------------- exact search


@query(_NN_SQL)
def knn_exact_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stored(spark, sf_dir)
    return _found(knn.knn_arrow(query_rows(refs), refs, K, leave_self=True))


@query(_NN_SQL)
def knn_exact_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stored(spark, sf_dir)
    return _found(knn.knn_sql(query_rows(refs), refs, K, leave_self=True))


@query(f"{_VEC}, pairs AS (SELECT q.event_id AS query_id, r.event_id AS ref_id, {_FLOAT_KEY} AS d FROM vec q JOIN vec r ON q.event_id <> r.event_id WHERE q.event_id % {EVERY} = 0) SELECT query_id, rank::INT AS rank, ref_id, round(sqrt(d), 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM pairs) WHERE rank <= {K}")
def knn_exact_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "vectors")
    vectors(spark, sf_dir).where("error IS NULL").select(F.col("event_id").alias("ref_id"), *V, is_fraud(F.col("label")).alias("fraud")).write.parquet(path)
    rows = spark.read.parquet(path)
    found = knn.knn_float(rows.where(F.col("ref_id") % EVERY == 0).withColumnRenamed("ref_id", "query_id"), rows, K, leave_self=True)
    return found.select("query_id", "rank", "ref_id", F.round(F.sqrt("distance_key"), 9).alias("distance"))


_FEW = " UNION ALL ".join(f"SELECT {i} AS ref_id, {k} AS distance_key" for i, k in ((0, 100), (1, 100), (2, 6400)))


@query(f"SELECT e.event_id AS query_id, row_number() OVER (PARTITION BY e.event_id ORDER BY f.distance_key, f.ref_id)::INT AS rank, f.ref_id::BIGINT AS ref_id, f.distance_key::BIGINT AS distance_key FROM events e, ({_FEW}) f WHERE e.event_id % {EVERY} = 0")
def knn_k_larger_than_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbours of three references: all three, ties by id."""
    refs = spark.createDataFrame([(0, 10, 1), (1, 10, 0), (2, 80, 0)], "ref_id long, c0 long, fraud int").select("ref_id", "c0", *[F.lit(0).cast("long").alias(c) for c in COORDINATES[1:]], "fraud")
    qs = adapters.events(spark, sf_dir).where(F.col("event_id") % EVERY == 0).select(F.col("event_id").alias("query_id"), *[F.lit(0).cast("long").alias(c) for c in COORDINATES])
    return knn.knn_arrow(qs, refs, K).select("query_id", "rank", "ref_id", "distance_key")


@query(f"{_PAIRS}, t AS (SELECT query_id, min(distance_key) AS m FROM pairs GROUP BY query_id) SELECT p.query_id, min(p.ref_id) AS ref_id, count(*) AS tied FROM pairs p JOIN t ON p.query_id = t.query_id AND p.distance_key = t.m GROUP BY p.query_id")
def knn_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first neighbour is the smallest id among all references at the least distance."""
    refs = stored(spark, sf_dir)
    return knn.knn_first(query_rows(refs), refs, leave_self=True).select("query_id", "ref_id", "tied")


_EMB = f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round((x::DOUBLE + 1) / 2 * {SCALE})::BIGINT) AS c, label FROM embeddings), p AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, r.label, list_sum(list_transform(list_zip(q.c, r.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance_key FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % {EVERY} = 0), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance_key, ref_id) AS rank FROM p) WHERE rank <= {K})"


def _embedding_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = adapters.embedding_coordinates(spark, sf_dir)
    return knn.knn_arrays(emb.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "coords"), emb.withColumnRenamed("vec_id", "ref_id"), K, leave_self=True)


@query(f"{_EMB} SELECT query_id, rank::INT AS rank, ref_id, distance_key, label FROM n")
def knn_embeddings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedding_neighbors(spark, sf_dir).select("query_id", "rank", "ref_id", "distance_key", "label")


@query(f"{_EMB}, v AS (SELECT query_id, label, count(*) AS votes, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS r FROM n GROUP BY 1, 2) SELECT query_id, label AS predicted, votes FROM v WHERE r = 1")
def knn_embeddings_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority vote, ties to the smaller label."""
    votes = _embedding_neighbors(spark, sf_dir).groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    best = votes.groupBy("query_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("b"))
    return best.select("query_id", F.col("b.label").alias("predicted"), (-F.col("b.v")).alias("votes"))


@query(f"{_PACK} SELECT ref_id, fraud, {' + '.join(f'(c{i} - {v}) * (c{i} - {v})' for i, v in enumerate([32767] * 14))} AS distance_key FROM pk ORDER BY distance_key, ref_id LIMIT 5")
def nearest_single_query_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest([32767] * 14, packed(spark, sf_dir), K)


# ---------------------------------------------------------------- decisions


@query(f"{_DECIDE} SELECT query_id, neighbors, fraud_count, fraud_score, fraud_score < 0.6::DOUBLE AS approved, NULL::VARCHAR AS error FROM dec")
def decide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stored(spark, sf_dir)
    return decide.decide(knn.knn_arrow(query_rows(refs), refs, K, leave_self=True))


def _leave_self(q: DataFrame, r: DataFrame, k: int) -> DataFrame:
    return knn.knn_arrow(q, r, k, leave_self=True)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_requests(spark, sf_dir).where(F.col("event_id") % EVERY == 0).withColumn("query_id", F.col("event_id"))


@query(f"{_DECIDE} SELECT query_id, fraud_count, fraud_score, fraud_score < 0.6::DOUBLE AS approved, 200 AS status_code FROM dec")
def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested requests to decisions: vectorize, search, vote."""
    scored = decide.score(_asked(spark, sf_dir), stored(spark, sf_dir), search=_leave_self)
    return scored.select("query_id", "fraud_count", "fraud_score", "approved", "status_code")


#: Every kind of failure, by event_id % 5: no vector, a search that fails, too few references, a body that can't be read; then none.
@query(
    f"{_DECIDE} SELECT event_id, CASE event_id // {EVERY} % 5 WHEN 3 THEN 400 WHEN 4 THEN 200 ELSE 500 END AS status_code, CASE event_id // {EVERY} % 5 WHEN 0 THEN 'vectorize request' WHEN 1 THEN 'search nearest neighbors' WHEN 2 THEN 'decide' WHEN 3 THEN 'decode' END AS error_stage, "
    f"CASE WHEN event_id // {EVERY} % 5 = 4 THEN fraud_score END AS fraud_score FROM events LEFT JOIN dec ON query_id = event_id WHERE event_id % {EVERY} = 0"
)
def score_error_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, asked = stored(spark, sf_dir), _asked(spark, sf_dir)
    kind = F.floor(F.col("event_id") / EVERY) % 5
    zero = F.col("customer").withField("avg_amount", F.lit(0.0))

    def failing(q: DataFrame, r: DataFrame, k: int) -> DataFrame:
        raise ValueError("no index")

    parts = [
        decide.score(asked.where(kind == 0).withColumn("customer", zero), refs, search=_leave_self),
        decide.score(asked.where(kind == 1), refs, search=failing),
        decide.score(asked.where(kind == 2), refs.limit(3), search=knn.knn_arrow),
        decide.score(asked.where(kind == 4), refs, search=_leave_self),
    ]
    scored = reduce(DataFrame.unionByName, parts)
    broken = requests.parse_requests(asked.where(kind == 3).select("query_id", F.lit('{"id":').alias("value")))
    return decide.status(broken, scored).select(F.col("query_id").alias("event_id"), "status_code", "error_stage", "fraud_score")


@query(f"SELECT row_number() OVER (ORDER BY event_id)::INT - 1 AS position, event_id::VARCHAR AS id, label = 'legit' AS expected_approved, amount FROM (SELECT event_id, value * 60 AS amount, CASE WHEN event_type = 'error' OR value > 300 THEN 'fraud' ELSE 'legit' END AS label FROM events WHERE event_id % {EVERY} = 0)")
def labelled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled test-set file, written and read again."""
    path = fresh(spark, "labelled")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    tx = F.col("transaction").withField("requested_at", stamp(F.col("transaction.requested_at")))
    last = F.when(F.col("last_transaction").isNotNull(), F.col("last_transaction").withField("timestamp", stamp(F.col("last_transaction.timestamp"))))
    request = F.struct("id", tx.alias("transaction"), "customer", "merchant", "terminal", last.alias("last_transaction"))
    entry = F.struct("event_id", request.alias("request"), (F.col("label") == "legit").alias("expected_approved"))
    entries = _asked(spark, sf_dir).agg(F.sort_array(F.collect_list(entry)).alias("entries"))  # the file is one document
    entries.select(F.to_json(F.struct("entries")).alias("value")).write.text(path)
    rows = requests.read_labelled(spark, path)
    return rows.select("position", "request.id", "expected_approved", F.col("request.transaction.amount").alias("amount"))


@query(f"{_DECIDE} SELECT fraud_score, fraud_score < 0.6::DOUBLE AS approved, count(*) AS n FROM dec GROUP BY 1, 2")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide_scores(spark, sf_dir).groupBy("fraud_score", "approved").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- cells


def _cells_sql() -> str:
    """Cells by lower medians of all rows; then their boxes."""
    levels = ["s0 AS (SELECT *, 0 AS cell FROM pk)"]
    for i in range(cells.LEVELS):
        c = COORDINATES[i % len(COORDINATES)]
        levels.append(f"m{i} AS (SELECT cell, {c} AS cut FROM (SELECT cell, {c}, row_number() OVER (PARTITION BY cell ORDER BY {c}) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM s{i}) WHERE rn = (n + 1) // 2)")
        levels.append(f"s{i + 1} AS (SELECT s.* EXCLUDE (cell), s.cell * 2 + ({c} > cut)::INT AS cell FROM s{i} s JOIN m{i} m ON s.cell = m.cell)")
    sides = ", ".join(f"min({c}) AS low_{c}, max({c}) AS high_{c}" for c in COORDINATES)
    return f"{_PACK}, {', '.join(levels)}, bx AS (SELECT cell, count(*) AS n, {sides} FROM s{cells.LEVELS} GROUP BY cell)"


_CELLS = _cells_sql()
_BOUND = " + ".join(f"greatest(low_{c} - q.{c}, q.{c} - high_{c}, 0) * greatest(low_{c} - q.{c}, q.{c} - high_{c}, 0)" for c in COORDINATES)
_ASKED = f"SELECT ref_id AS query_id, {', '.join(COORDINATES)} FROM pk WHERE ref_id % {EVERY} = 0"
_BUDGET = 32


@query(f"{_CELLS} SELECT * FROM bx")
def cell_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of every cell."""
    return cell_index(spark, sf_dir).boxes


@query(f"{_CELLS} SELECT ref_id, cell FROM s{cells.LEVELS}")
def cell_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of every row, as the index stores it."""
    return cell_index(spark, sf_dir).rows.select("ref_id", "cell")


@query(_NN_SQL)
def knn_cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(cells.knn_cells(query_rows(stored(spark, sf_dir)), cell_index(spark, sf_dir), K, leave_self=True))


@query(
    f"{_CELLS}, near AS (SELECT * FROM (SELECT query_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY bound, cell) AS nth FROM (SELECT query_id, cell, {_BOUND} AS bound FROM ({_ASKED}) q, bx)) WHERE nth <= {_BUDGET}), "
    f"pairs AS (SELECT n.query_id, r.ref_id, r.fraud, {_KEY} AS distance_key FROM near n JOIN s{cells.LEVELS} r ON n.cell = r.cell JOIN pk q ON q.ref_id = n.query_id WHERE n.query_id <> r.ref_id), "
    f"nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance_key, ref_id) AS rank FROM pairs) WHERE rank <= {K}) SELECT {_NN_COLUMNS} FROM nn"
)
def knn_cells_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(cells.knn_cells_budget(query_rows(stored(spark, sf_dir)), cell_index(spark, sf_dir), K, cells=_BUDGET, leave_self=True))


# ---------------------------------------------------------------- hashing


def _signature_sql(seed: int) -> str:
    return " + ".join("(CASE WHEN " + " + ".join(f"({s}) * (c{i} - 32767)" for i, s in enumerate(p)) + f" >= 0 THEN {1 << b}::BIGINT ELSE 0::BIGINT END)" for b, p in enumerate(planes(seed)))


_PROJECTION = " + ".join(f"c{i} * ({w})" for i, w in enumerate(WEIGHTS))
_COARSE = " + ".join(f"(greatest(c{d}, 0) >> 13) * {1 << (3 * d)}" for d in range(4))
_LSH = f"{_PACK}, ix AS (SELECT *, {_signature_sql(SEEDS[0])} AS sig0, {_signature_sql(SEEDS[1])} AS sig1, {_COARSE} AS coarse, {_PROJECTION} AS projection FROM pk)"


@query(f"{_LSH} SELECT ref_id, sig0, sig1 FROM ix")
def lsh_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("ref_id", signature(SEEDS[0]).alias("sig0"), signature(SEEDS[1]).alias("sig1"))


@query(f"{_LSH} SELECT ref_id, projection FROM ix")
def lsh_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("ref_id", projection().alias("projection"))


@query(f"{_LSH} SELECT ref_id, coarse FROM ix")
def lsh_coarse_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("ref_id", coarse_cell().alias("coarse"))


@query(f"WITH m AS (SELECT i::BIGINT AS mask, bit_count(i::BIGINT)::INT AS bits FROM range(0, {1 << BITS}) r(i)) SELECT mask, bits FROM m WHERE bits <= 3")
def lsh_probe_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = spark.createDataFrame([(m,) for m in probe_masks(3)], "mask long")
    return masks.select("mask", F.bit_count("mask").alias("bits"))


@query(f"{_LSH} SELECT q.ref_id AS query_id, r.ref_id FROM ix q JOIN ix r ON q.sig0 = r.sig0 AND q.ref_id <> r.ref_id WHERE q.ref_id % {EVERY} = 0")
def lsh_bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = lsh.index(stored(spark, sf_dir))
    q = ix.where(F.col("ref_id") % EVERY == 0).select(F.col("ref_id").alias("query_id"), "sig0")
    return ix.select("ref_id", "sig0").join(q, "sig0").where("query_id <> ref_id").select("query_id", "ref_id")


_CAP = lsh.CAP


@query(
    f"{_LSH}, rk AS (SELECT *, row_number() OVER (PARTITION BY coarse ORDER BY projection, ref_id) AS rk, count(*) OVER (PARTITION BY coarse) AS n FROM ix), "
    f"j AS (SELECT q.ref_id AS query_id, r.ref_id, r.rk, r.n, greatest(0, sum((r.projection < q.projection)::INT) OVER (PARTITION BY q.ref_id) - {_CAP // 2}) AS low FROM ix q JOIN rk r ON q.coarse = r.coarse WHERE q.ref_id % {EVERY} = 0) "
    f"SELECT query_id, ref_id, rk::INT AS rk FROM j WHERE rk > CASE WHEN low + {_CAP} > n THEN greatest(0, n - {_CAP}) ELSE low END AND rk <= least(n, low + {_CAP})"
)
def lsh_rank_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references of a bucket nearest by projection, as many as a rank window holds."""
    ix = hash_index(spark, sf_dir)
    probes = ix.where(F.col("ref_id") % EVERY == 0).select(F.col("ref_id").alias("query_id"), F.lit(0).alias("ordinal"), F.col("coarse").alias("key"), F.col("projection").alias("q_projection"))
    return lsh.window_of(probes, lsh.bucket_ranks(ix.select("ref_id", "coarse", "projection"), "coarse"), "coarse", _CAP).select("query_id", "ref_id", "rk")


def _staged_sql(radius: int, enough: int | None) -> str:
    """Candidates with the first stage in which they meet the query; stages are read while the earlier ones held too few."""
    last = 2 * (radius + 1)
    far = lambda t: f"bit_count(xor(q.sig{t}, r.sig{t}))::INT"
    first = f"least({', '.join(f'CASE WHEN {far(t)} <= {radius} THEN 2 * {far(t)} + {t} ELSE 99 END' for t in (0, 1))})"
    if enough is None:
        first = f"CASE WHEN {first} < 99 THEN 0 ELSE 99 END"
    stop = f"CASE WHEN s = {last} THEN {K} ELSE {enough or 1} END"
    return (
        f"{_LSH}, c0 AS (SELECT q.ref_id AS query_id, r.ref_id, r.fraud, {_KEY} AS distance_key, {first} AS s, q.coarse = r.coarse AS same FROM ix q JOIN ix r ON q.ref_id <> r.ref_id WHERE q.ref_id % {EVERY} = 0), "
        f"c1 AS (SELECT query_id, ref_id, fraud, distance_key, CASE WHEN s = 99 THEN {last} ELSE s END AS s FROM c0 WHERE s < 99 OR same), "
        f"st AS (SELECT query_id, s, coalesce(sum(count(*)) OVER (PARTITION BY query_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c1 GROUP BY query_id, s), "
        f"nn AS (SELECT * FROM (SELECT c1.*, row_number() OVER (PARTITION BY c1.query_id ORDER BY distance_key, ref_id) AS rank FROM c1 JOIN st USING (query_id, s) WHERE before < {stop}) WHERE rank <= {K}) SELECT {_NN_COLUMNS} FROM nn"
    )


@query(_staged_sql(lsh.RADIUS, None))
def lsh_staged_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All buckets within the default radius in both tables, the coarse cell where they hold too few."""
    return _found(lsh.knn_lsh(query_rows(stored(spark, sf_dir)), hash_index(spark, sf_dir), K, leave_self=True))


@query(_staged_sql(3, K))
def lsh_frugal_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but a query stops at the first stage that has given it k references: few reads, low recall."""
    return _found(lsh.knn_lsh(query_rows(stored(spark, sf_dir)), hash_index(spark, sf_dir), K, radius=3, enough=K, leave_self=True))


@query(
    f"{_CELLS}{_PAIRS[len(_PACK) :]}, far AS (SELECT query_id, max(distance_key) AS radius FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance_key, ref_id) AS rank FROM pairs) WHERE rank <= {K} GROUP BY 1), "
    f"vis AS (SELECT q.query_id, sum(n)::BIGINT AS visited FROM ({_ASKED}) q JOIN far USING (query_id), bx WHERE {_BOUND} <= radius GROUP BY 1) SELECT avg(visited) AS mean_visited, max(visited) AS max_visited FROM vis"
)
def knn_cells_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and most references that an exact cell search can't leave out."""
    visited = cells.visited_rows(query_rows(stored(spark, sf_dir)), cell_index(spark, sf_dir), K, leave_self=True)
    return visited.agg(F.avg("visited").alias("mean_visited"), F.max("visited").alias("max_visited"))


_CANDIDATES = f"{_LSH}, b AS (SELECT sig0, count(*) AS n FROM ix GROUP BY 1), cc AS (SELECT least(n, {lsh.CAP}) AS candidates FROM ix JOIN b USING (sig0) WHERE ref_id % {EVERY} = 0)"


@query(f"{_CANDIDATES}, o AS (SELECT candidates, row_number() OVER (ORDER BY candidates) - 1 AS i, count(*) OVER () AS n FROM cc) SELECT avg(candidates) AS mean_candidates, max(candidates) AS max_candidates, max(candidates) FILTER (i = n * 95 // 100) AS p95 FROM o")
def lsh_candidate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, floor-index p95 and most candidates of the first stage."""
    refs = stored(spark, sf_dir)
    counts = lsh.candidate_counts(query_rows(refs), refs)
    whole = counts.agg(F.avg("candidates").alias("mean_candidates"), F.max("candidates").alias("max_candidates"))
    return whole.crossJoin(evaluate.at_places(counts, "candidates", {"p95": evaluate.floor_index(95)}))


# ---------------------------------------------------------------- evaluation


@query("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.at_places(adapters.events(spark, sf_dir), "value", {f"p{p}": evaluate.nearest_rank(p) for p in (50, 95, 99)})


@query("SELECT value AS p95 FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i = n * 95 // 100")
def p95_floor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.at_places(adapters.events(spark, sf_dir), "value", {"p95": evaluate.floor_index(95)})


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events(spark, sf_dir).select(F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.concat(F.lit("api-"), (F.col("user_id") % 2).cast("string")).alias("instance"), "ts")


@query("SELECT 'api-' || (user_id % 2)::VARCHAR AS instance, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def count_by_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_instance(_samples(spark, sf_dir))


@query("SELECT count(*) FILTER (event_type <> 'error') AS ok, min(value) FILTER (event_type <> 'error') AS min_ms, max(value) FILTER (event_type <> 'error') AS max_ms, quantile_disc(value, 0.5) FILTER (event_type <> 'error') AS p50, quantile_disc(value, 0.95) FILTER (event_type <> 'error') AS p95, quantile_disc(value, 0.99) FILTER (event_type <> 'error') AS p99, count(*) FILTER (event_type = 'error') AS errors, count(*) AS total, count(*) / 60.0::DOUBLE AS throughput FROM events")
def throughput_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.load_summary(_samples(spark, sf_dir), 60.0)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stored(spark, sf_dir)
    got = decide.decide(knn.knn_arrow(query_rows(refs), refs, K, leave_self=True))
    truth = refs.select(F.col("ref_id").alias("query_id"), (F.col("fraud") == 0).alias("expected_approved"))
    return got.join(truth, "query_id").withColumn("failed", F.col("error").isNotNull())


_CONFUSION = f"{_DECIDE}, cm AS (SELECT count(*) FILTER (fraud_score >= 0.6::DOUBLE AND pk.fraud = 1) AS tp, count(*) FILTER (fraud_score < 0.6::DOUBLE AND pk.fraud = 0) AS tn, count(*) FILTER (fraud_score >= 0.6::DOUBLE AND pk.fraud = 0) AS fp, count(*) FILTER (fraud_score < 0.6::DOUBLE AND pk.fraud = 1) AS fn, 0::BIGINT AS err, count(*) AS n FROM dec JOIN pk ON query_id = pk.ref_id)"


@query(f"{_CONFUSION} SELECT * FROM cm")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_judged(spark, sf_dir))


@query(f"{_CONFUSION} SELECT fp + fn AS mismatches, err AS errors, n AS total, (fp + fn) * 100.0::DOUBLE / n AS mismatches_percent, 0.0::DOUBLE AS errors_percent FROM cm")
def mismatch_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mismatch(_judged(spark, sf_dir))


_GRID = "g AS (SELECT event_id, event_id % 60 AS fp, event_id % 41 AS fn, event_id % 13 AS err, 1000::BIGINT AS n, value * 8 AS p99 FROM events), s AS (SELECT *, fp + 3 * fn + 5 * err AS weighted_errors, (fp + fn + err)::DOUBLE / n AS failure_rate FROM g), t AS (SELECT event_id, p99, failure_rate > 0.15::DOUBLE AS cut, CASE WHEN failure_rate > 0.15::DOUBLE THEN -3000::DOUBLE ELSE 1000 * log10(1 / greatest(weighted_errors::DOUBLE / n, 0.001::DOUBLE)) - 300 * log10(1 + weighted_errors) END AS detection, CASE WHEN p99 > 2000 THEN -3000::DOUBLE ELSE 1000 * log10(1000 / greatest(p99, 1)) END AS latency FROM s)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return evaluate.with_scores(adapters.events(spark, sf_dir).select("event_id", (e % 60).alias("fp"), (e % 41).alias("fn"), (e % 13).alias("err"), F.lit(1000).cast("long").alias("n"), (F.col("value") * 8).alias("p99")))


@query(f"WITH {_GRID} SELECT event_id, round(detection, 4) AS detection_score, cut AS detection_cut FROM t")
def detection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("event_id", F.round("detection_score", 4).alias("detection_score"), "detection_cut")


@query(f"WITH {_GRID} SELECT event_id, round(latency, 4) AS p99_score, round(latency + detection, 4) AS final_score FROM t")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("event_id", F.round("p99_score", 4).alias("p99_score"), F.round("final_score", 4).alias("final_score"))


_REPORT = (
    f"{_CONFUSION}, p AS (SELECT quantile_disc(value, 0.99) AS p99 FROM events), a AS (SELECT *, fp + 3 * fn + 5 * err AS e, (fp + fn + err)::DOUBLE / n AS fr, p99 > 2000 AS late FROM cm, p), "
    "b AS (SELECT *, fr > 0.15::DOUBLE AS cut, CASE WHEN fr <= 0.15::DOUBLE THEN 1000 * log10(1 / greatest(e::DOUBLE / n, 0.001::DOUBLE)) END AS rate, CASE WHEN fr <= 0.15::DOUBLE THEN -300 * log10(1 + e) END AS penalty, CASE WHEN late THEN -3000::DOUBLE ELSE 1000 * log10(1000 / greatest(p99, 1)) END AS latency FROM a) "
    "SELECT n AS total, tp + fn AS fraud_count, round((tp + fn) * 100.0::DOUBLE / n, 2) AS fraud_rate, printf('%.2f', p99) AS p99, tp, tn, fp, fn, err, printf('%.2f%%', fr * 100) AS failure_rate, e::BIGINT AS weighted_errors, round(e::DOUBLE / n, 6) AS epsilon, "
    "round(latency, 2) AS p99_score, late AS p99_cut, round(coalesce(rate + penalty, -3000::DOUBLE), 2) AS detection_score, round(rate, 2) AS rate_component, round(penalty, 2) AS absolute_penalty, cut AS detection_cut, round(latency + coalesce(rate + penalty, -3000::DOUBLE), 2) AS final_score FROM b"
)


@query(_REPORT)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result document of a leave-one-out evaluation, latencies from the events table, read back from its JSON text field by field."""
    judged = _judged(spark, sf_dir)
    expected = judged.agg(F.count("*").alias("total"), F.count_if(~F.col("expected_approved")).alias("fraud_count"))
    p99 = evaluate.at_places(adapters.events(spark, sf_dir), "value", {"p99": evaluate.nearest_rank(99)})
    made = evaluate.report(evaluate.with_scores(evaluate.confusion(judged).crossJoin(p99)).crossJoin(expected))
    doc = made.select(F.from_json("result", made.schema["doc"].dataType).alias("d"))
    s = "d.scoring."
    fields = {
        "total": "d.expected.total", "fraud_count": "d.expected.fraud_count", "fraud_rate": "d.expected.fraud_rate", "p99": "d.p99",
        "tp": f"{s}breakdown.true_positive_detections", "tn": f"{s}breakdown.true_negative_detections", "fp": f"{s}breakdown.false_positive_detections", "fn": f"{s}breakdown.false_negative_detections", "err": f"{s}breakdown.http_errors",
        "failure_rate": f"{s}failure_rate", "weighted_errors": f"{s}weighted_errors_E", "epsilon": f"{s}error_rate_epsilon", "p99_score": f"{s}p99_score.value", "p99_cut": f"{s}p99_score.cut_triggered",
        "detection_score": f"{s}detection_score.value", "rate_component": f"{s}detection_score.rate_component", "absolute_penalty": f"{s}detection_score.absolute_penalty", "detection_cut": f"{s}detection_score.cut_triggered", "final_score": f"{s}final_score",
    }
    return doc.select(*[F.col(path).alias(name) for name, path in fields.items()])


# ---------------------------------------------------------------- streaming


_ANSWER = """'{"approved":' || (fraud_score < 0.6::DOUBLE)::VARCHAR || ',"fraud_score":' || fraud_score::VARCHAR || '}'"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    asked = _asked(spark, sf_dir)
    tx = F.col("transaction").withField("requested_at", stamp(F.col("transaction.requested_at")))
    last = F.when(F.col("last_transaction").isNotNull(), F.col("last_transaction").withField("timestamp", stamp(F.col("last_transaction.timestamp"))))
    return asked.select(F.to_json(F.struct("id", tx.alias("transaction"), "customer", "merchant", "terminal", last.alias("last_transaction"))).alias("value"))


@query(f"{_top(K).replace('ON q.ref_id <> r.ref_id', 'ON true')}, dec AS (SELECT query_id, sum(fraud)::DOUBLE / 5.0::DOUBLE AS fraud_score FROM nn GROUP BY 1) SELECT query_id::VARCHAR AS id, 200 AS status_code, fraud_score < 0.6::DOUBLE AS approved, fraud_score, {_ANSWER} AS body FROM dec")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies read as a stream, scored batch by batch against all references."""
    root = fresh(spark, "stream")
    _bodies(spark, sf_dir).repartition(3).write.text(f"{root}/in")
    run = scoring.start(scoring.read_bodies(spark, f"{root}/in", 1), stored(spark, sf_dir), f"{root}/out", f"{root}/checkpoint", once=True)
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("id", "status_code", "approved", "fraud_score", "body")
