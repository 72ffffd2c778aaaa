"""Requests and labelled vectors derived from the ``events`` and ``embeddings`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.packing import SCALE

#: Categories in turn; the last two are unknown to the risk table.
MCC_CYCLE = ("5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "0000", "9999")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _merchant(number):
    return F.concat(F.lit("MERC-"), F.lpad(number.cast("string"), 3, "0"))


def requests_from_events(ev: DataFrame) -> DataFrame:
    """One nested request for each event, plus its event_id and label."""
    e, u = F.col("event_id"), F.col("user_id")
    user = Window.partitionBy("user_id")
    by_time = user.orderBy("ts", "event_id")
    day = user.orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).over(user).cast("double")
    df = ev.withColumns({
        "avg_amount": cents / F.count("*").over(user) / 100.0 * 15.0,
        "tx_count_24h": F.count("*").over(day).cast("int"),
        "last_ts": F.when(e % 4 != 0, F.lag("ts").over(by_time)),
    })
    return df.select(
        "event_id",
        e.cast("string").alias("id"),
        F.struct((F.col("value") * 60).alias("amount"), (1 + e % 15).cast("int").alias("installments"), F.col("ts").alias("requested_at")).alias("transaction"),
        F.struct("avg_amount", "tx_count_24h", F.array(*[_merchant((u + k) % 50) for k in (0, 7, 23)]).alias("known_merchants")).alias("customer"),
        F.struct(_merchant(e % 50).alias("id"), F.get(F.array(*[F.lit(m) for m in MCC_CYCLE]), (e % 12).cast("int")).alias("mcc"), ((e % 50) * 250 + 5.25).cast("double").alias("avg_amount")).alias("merchant"),
        F.struct(F.col("event_type").isin("click", "view").alias("is_online"), (F.col("event_type") == "purchase").alias("card_present"), (e * 37 % 1200 + 0.5).cast("double").alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_ts").isNotNull(), F.struct(F.col("last_ts").alias("timestamp"), (e * 53 % 1100).cast("double").alias("km_from_current"))).alias("last_transaction"),
        F.when((F.col("event_type") == "error") | (F.col("value") > 300), "fraud").otherwise("legit").alias("label"),
    )


#: The same derivation for DuckDB, as common table expressions that end in ``req``.
REQUEST_SQL = f"""
ev AS (
  SELECT *,
    sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id)::BIGINT::DOUBLE / count(*) OVER (PARTITION BY user_id) / 100.0::DOUBLE * 15.0::DOUBLE AS avg_amount,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS tx_count_24h,
    CASE WHEN event_id % 4 <> 0 THEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS last_ts
  FROM events),
req AS (
  SELECT event_id, ts, user_id, event_type, value * 60 AS amount, 1 + event_id % 15 AS installments, avg_amount, tx_count_24h,
    'MERC-' || lpad((event_id % 50)::VARCHAR, 3, '0') AS merchant_id,
    list_transform([user_id % 50, (user_id + 7) % 50, (user_id + 23) % 50], lambda x: 'MERC-' || lpad(x::VARCHAR, 3, '0')) AS known,
    {list(MCC_CYCLE)}[event_id % 12 + 1] AS mcc,
    ((event_id % 50) * 250 + 5.25)::DOUBLE AS merchant_avg,
    event_type IN ('click', 'view') AS is_online, event_type = 'purchase' AS card_present,
    (event_id * 37 % 1200 + 0.5)::DOUBLE AS km_home, last_ts, (event_id * 53 % 1100)::DOUBLE AS km_last,
    CASE WHEN event_type = 'error' OR value > 300 THEN 'fraud' ELSE 'legit' END AS label
  FROM ev)"""


def embedding_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, coords, label): values of [-1, 1] as integers 0..65534."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coords = F.transform("embedding", lambda x: F.round((x.cast("double") + 1) / 2 * SCALE).cast("long"))
    return emb.select("vec_id", coords.alias("coords"), "label")
