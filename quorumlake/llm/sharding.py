"""Sharding by extendible hashing [native].

The directory is indexed by the leading bits of a hash of the document id.  It starts as one
bucket; only buckets above the byte limit are split on another bit, until every one fits.  Bucket
sizes are sums by hash prefix, taken before any shuffle of rows, so a directory step moves one row
per prefix; ``STEP`` bits are tried at a time, and only documents of buckets that are still too
large take part in the next step.

Rows of one id stay together while they fit.  Where they exceed the limit their bucket splits further
on the bits of a second hash, of the text, and copies of one text on those of their numbers in a
table, so a shard is above the limit (``oversize``) only if it is a single document.

Defined cases: null and empty texts have 0 bytes and are placed like any other; a row without an id is
placed by its text; which of several equal rows goes to which shard is open, all else is the same in
every run; an empty table gives no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side, text_of

BITS = 60
STEP = 10
SHARD_BYTES = 16 << 20
MAX_BROADCAST_CELLS = 200_000


def hash_bits(value: Column) -> Column:
    """60 hash bits of a string, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(value), 1, BITS // 4), 16, 10).cast("long")


def hashes(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """The hashes of the first two levels: of the id (of the text, where there is none), and of the text."""
    by_text = F.concat(F.lit("text:"), F.md5(text))
    return hash_bits(F.coalesce(doc_id.cast("string"), by_text)), hash_bits(by_text)


def _prefix(h: Column, bits: int | Column) -> Column:
    return F.call_function("shiftright", h, F.lit(BITS) - bits)


def build_directory(sized: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Steps (bits, cells) of ``sized`` (root, h, bytes): cells (root, prefix, depth, shard_bytes, shard_docs, oversize).

    A cell without a depth belongs to a bucket that the next step splits.
    """
    steps: list[tuple[int, DataFrame]] = []
    low, rows = -1, sized
    while low < BITS:
        bits = min(BITS, max(low, 0) + STEP)
        cells = rows.groupBy("root", _prefix(F.col("h"), bits).alias("prefix")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        up = cells.select("root", "prefix", "b", "n", F.explode(F.sequence(F.lit(low + 1), F.lit(bits))).alias("depth"))
        shorter = F.call_function("shiftright", F.col("prefix"), F.lit(bits) - F.col("depth"))
        nodes = up.groupBy("root", "depth", shorter.alias("node")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = nodes.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        leaf = F.struct("depth", "shard_bytes", "shard_docs")
        near = up.withColumn("node", shorter).select("root", "prefix", "depth", "node").join(fits, ["root", "depth", "node"], "left")
        best = near.groupBy("root", "prefix").agg(F.min(F.when(F.col("shard_bytes").isNotNull(), leaf)).alias("leaf"))
        table = materialize(best.select("root", "prefix", "leaf.*", (F.col("leaf.shard_bytes") > limit).alias("oversize")), f"shard-cells-{bits}")
        steps.append((bits, table))
        large = table.where("depth is null")
        if large.isEmpty():
            break
        side = small_side(large.select(F.col("root").alias("large_root"), "prefix"), MAX_BROADCAST_CELLS)
        rows = rows.join(side, (F.col("root") == F.col("large_root")) & (_prefix(F.col("h"), bits) == F.col("prefix")), "left_semi")
        low = bits
    return steps


PLACE = ("depth", "shard_bytes", "shard_docs", "oversize")


def place(rows: DataFrame, steps: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` plus shard, depth, shard_bytes, shard_docs and oversize, by their columns ``root`` and ``h``."""
    for k, (bits, cells) in enumerate(steps):
        side = small_side(cells.where("depth is not null"), MAX_BROADCAST_CELLS).select(F.col("root").alias(f"root{k}__"), F.col("prefix").alias(f"p{k}__"), *[F.col(c).alias(f"{c}{k}__") for c in PLACE])
        rows = rows.join(side, (F.col("root") == F.col(f"root{k}__")) & (_prefix(F.col("h"), bits) == F.col(f"p{k}__")), "left")
    rows = rows.withColumns({c: F.coalesce(*[F.col(f"{c}{k}__") for k in range(len(steps))]) for c in PLACE})
    binary = F.lpad(F.conv(_prefix(F.col("h"), F.col("depth")).cast("string"), 10, 2), F.col("depth"), F.lit("0"))
    rows = rows.withColumn("shard", F.concat("root", F.when(F.col("depth") == 0, "").otherwise(binary))).withColumn("depth", F.length("shard"))
    return rows.drop(*[f"{c}{k}__" for k in range(len(steps)) for c in ("root", "p", *PLACE)])


def split(rows: DataFrame, limit: int, level: int = 0) -> DataFrame:
    """``rows`` (root, h, h_text, bytes, ...) placed; shards of several rows above the limit go on with the next level's bits.

    Rows of such a shard become a table before the last level, so their numbers stay as they are.
    """
    steps = build_directory(materialize(rows.select("root", "h", "bytes"), "shard-sizes"), limit)
    placed = place(rows, steps)
    if level == 2 or steps[-1][1].where("oversize and shard_docs > 1").isEmpty():
        return placed
    heavy = F.col("oversize") & (F.col("shard_docs") > 1)
    h = F.col("h_text") if level == 0 else hash_bits(F.monotonically_increasing_id().cast("string"))
    deeper = materialize(placed.where(heavy).withColumn("root", F.col("shard")).withColumn("h", h).drop("shard", *PLACE), "shard-heavy")
    return placed.where(~heavy).unionByName(split(deeper, limit, level + 1))


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, oversize) for each row of ``docs``."""
    h, h_text = hashes(F.col("doc_id"), text_of("text"))
    sized = docs.select("doc_id", F.lit("").alias("root"), h.alias("h"), h_text.alias("h_text"), F.octet_length(text_of("text")).cast("long").alias("bytes"))
    return split(materialize(sized, "shard-rows"), limit).select("doc_id", F.col("bytes").alias("n_bytes"), "shard", *PLACE)


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``shard_bytes``; texts aren't shuffled, and only those of heavy ids are written once more."""
    h, h_text = hashes(F.col("doc_id"), text_of("text"))
    inner = [(f"in_{i}", c) for i, c in enumerate(docs.columns)]
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for a, c in inner], F.lit("").alias("root"), h.alias("h"), h_text.alias("h_text"), F.octet_length(text_of("text")).cast("long").alias("bytes"))
    return split(rows, limit).select(*[F.col(a).alias(c) for a, c in inner if c not in ("shard", "shard_bytes")], "shard", "shard_bytes")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; a shard is within the limit or one document, so its rows come together in one task."""
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


#: Without the second level: no id of the test tables has several rows above the limit.
ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
sums AS (
  SELECT doc_id, n_bytes, h, d, sum(n_bytes) OVER (PARTITION BY d, h >> ({BITS} - d))::BIGINT AS shard_bytes,
         count(*) OVER (PARTITION BY d, h >> ({BITS} - d)) AS shard_docs
  FROM sized, range(0, {BITS + 1}) r(d)),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS rn FROM sums WHERE shard_bytes <= {SHARD_BYTES} OR d = {BITS})
SELECT doc_id, n_bytes, right(lpad(CASE WHEN d = 0 THEN '' ELSE bin(h >> ({BITS} - d)) END, d::INT, '0'), d::INT) AS shard,
       d::INT AS depth, shard_bytes, shard_docs, shard_bytes > {SHARD_BYTES} AS oversize
FROM leaf WHERE rn = 1
"""
