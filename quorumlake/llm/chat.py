"""Chat formatting with cumulative-snapshot collapse [native].

A chat log often holds a conversation once after each turn.  The hash of the first i turns of a
conversation is the XOR of hashes of (position, role, text), two of 64 bits; a conversation whose
whole hash is a proper prefix hash of another one is a snapshot and goes (anti-join), equal
conversations stay once, under the smallest id.  The maximal ones are rendered as
``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.

Prefix hashes come from two levels of prefix sums, over blocks of turns and inside a block, and
rendering gives one row for each ``PART`` turns, so no task gathers a whole long conversation.

Defined cases: turns are ordered by (turn, role, text), null first; equal rows of one conversation
count once; null role or text reads as empty; rows with a null conv_id are dropped; many turns without a
number, or with one number, are ordered by ranges in several tasks; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

PART = 256
#: Turns of one block beyond which it is cut by ranges.
HEAVY = 10_000
MAX_BROADCAST_BLOCKS = 100_000


def _parted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sub``: blocks of more than ``HEAVY`` turns (equal or missing turn numbers) are cut by ranges of (turn, role, text)."""
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)
    heavy = materialize(sizes.select("conv_id", "block"), "chat-heavy")
    if heavy.isEmpty():
        return rows.withColumn("sub", F.lit(0))
    side, by = small_side(heavy, MAX_BROADCAST_BLOCKS), ["conv_id", "block"]
    ranged = rows.join(side, by, "left_semi").repartitionByRange("conv_id", "block", F.col("turn").asc_nulls_first(), "role", "text")
    ranged = materialize(ranged.withColumn("sub", F.spark_partition_id()), "chat-ranges")  # the ranges stay as they are
    return rows.join(side, by, "left_anti").withColumn("sub", F.lit(0)).unionByName(ranged)


def with_positions(log: DataFrame) -> DataFrame:
    """(conv_id, block, sub, pos, role, text): positions from 1 in each conversation."""
    rows = log.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    rows = materialize(rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(2**62)))), "chat-rows")
    rows = _parted(rows)
    sizes = rows.groupBy("conv_id", "block", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "block", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("conv_id", "block", "sub").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("rn", F.row_number().over(own)).join(offsets, ["conv_id", "block", "sub"]).select("conv_id", "block", "sub", (F.col("offset") + F.col("rn")).alias("pos"), "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2): hashes of the first ``pos`` turns."""
    item = turns.select("conv_id", "block", "sub", "pos", F.xxhash64("pos", "role", "text").alias("a"), F.xxhash64("text", "role", "pos").alias("b"))
    sums = item.groupBy("conv_id", "block", "sub").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv_id", "block", "sub", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ab"])
    upto = Window.partitionBy("conv_id", "block", "sub").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = item.select("conv_id", "block", "sub", "pos", *[F.bit_xor(c).over(upto).alias(f"{c}1") for c in "ab"])
    return rolled.join(offsets, ["conv_id", "block", "sub"]).select("conv_id", "pos", F.col("a0").bitwiseXOR(F.col("a1")).alias("h1"), F.col("b0").bitwiseXOR(F.col("b1")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged): conversations that are no proper prefix of another, one of equal ones."""
    hashes = materialize(prefix_hashes(turns), "chat-prefixes")
    length = hashes.groupBy("conv_id").agg(F.max("pos").alias("n"))
    marked = hashes.join(length, "conv_id")
    whole = marked.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    prefixes = marked.where("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(prefixes, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_logged")


def render(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged, part, rendered) in parts of ``PART`` turns."""
    line = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    part = F.floor((F.col("pos") - 1) / PART).cast("int")
    kept = turns.join(chosen, "conv_id").select("conv_id", "n_turns", "n_logged", part.alias("part"), F.struct("pos", line.alias("line")).alias("item"))
    lines = F.sort_array(F.collect_list("item"))
    return kept.groupBy("conv_id", "n_turns", "n_logged", "part").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered"))


def format_chats(log: DataFrame) -> DataFrame:
    turns = materialize(with_positions(log), "chat-turns")
    return render(turns, materialize(maximal(turns), "chat-maximal"))


ORACLE_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS l FROM p GROUP BY conv_id),
pre AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, len(l))) AS i FROM c)),
w AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_logged FROM c GROUP BY l),
m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.l = w.l))
SELECT m.conv_id, len(m.l)::BIGINT AS n_turns, m.n_logged, ((p.pos - 1) // {PART})::INT AS part,
       string_agg('<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.pos) AS rendered
FROM m JOIN p USING (conv_id) GROUP BY ALL
"""
