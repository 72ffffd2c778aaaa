"""Benchmark decontamination [native].

A document is contaminated by an item when one of its windows of the item's length in words has a
weighted-shingle similarity of at least 0.8 to it: with a_x and b_x the counts of the five-word
shingle x in window and item, sum(min(a_x, b_x)) / sum(max(a_x, b_x)).

1. Sieve, lossless: a window of that similarity holds at least 0.8 of the item's number of shingle
   places among its own, so only window starts with so many hits ahead of them remain.
2. The SimHash of each remaining window is looked up among the items of its size: fingerprints are
   cut into 8 blocks of 8 bits, items are indexed under every value within 2 bits of each of their
   blocks, and a window takes part with its own 8 block values.  Two fingerprints within
   ``RADIUS`` = 23 bits agree to 2 bits in some block, so every such pair is found.
3. Pairs found within the radius are verified by the exact similarity.

Words are lower-cased and rid of ASCII punctuation; words of nothing else vanish.

Defined cases: items of fewer than five words are not looked for; a document shorter than an item is
one window; null and empty texts are never contaminated; rows are told apart by id and text, so a null or
reused id never decides for another text, and copies of one row give one result; a very long text is cut
into parts of ``PART`` shingles before windows are taken from it; an empty table of documents or items
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, SPACE, let, matching, materialize, row_keys, small_side, text_of, without_rows

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
BLOCK_RADIUS = RADIUS // BLOCKS
MAX_BROADCAST_ROWS = 500_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Shingles of a document from which windows are cut at once.
PART = 1024


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, in order; empty for fewer words."""
    words = F.filter(F.split(F.translate(F.lower(text), PUNCTUATION, ""), SPACE + "+"), lambda w: w != "")
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    return let(words, lambda w: F.when(F.size(w) < SHINGLE, F.array().cast("array<bigint>")).otherwise(hashed(w)))


def simhash(hashes: Column) -> Column:
    """Bit b is 1 if set in over half of the hashes, repeats included."""

    def add(acc: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
        return acc.bitwiseOR(F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), add)


def _block(fp: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, i * 8).bitwiseAND(F.lit(255).cast("long")).cast("int")


def near_values() -> list[int]:
    """Masks of at most ``BLOCK_RADIUS`` of 8 bits."""
    return [m for m in range(256) if m.bit_count() <= BLOCK_RADIUS]


def similarity(a: Column, b: Column) -> Column:
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return let(both, lambda m: m / (F.size(a) + F.size(b) - m))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, th, item_id, start_word, n_shingles, similarity): the best window of each contaminated row and item."""
    items = benchmark.select("item_id", shingles(text_of("text")).alias("item_sh")).where("size(item_sh) > 0").withColumn("size", F.size("item_sh"))
    items = materialize(items, "decon-items")
    longest = items.agg(F.max("size")).first()[0] or 1
    index = items.select("item_id", "size", F.explode(F.array_distinct("item_sh")).alias("h"))
    placed = docs.select(*row_keys(), F.posexplode(shingles(text_of("text"))).alias("pos", "h"))
    hits = placed.join(small_side(materialize(index, "decon-index"), MAX_BROADCAST_ROWS), "h").select("id", "th", "item_id", "size", "pos").distinct()
    least = F.ceil(F.lit(SIMILARITY) * F.col("size"))
    # does the window that begins at this hit hold enough hits?
    run = Window.partitionBy("id", "th", "item_id").orderBy("pos")
    ranked = hits.withColumn("rn", F.row_number().over(run))
    ahead = ranked.select("id", "th", "item_id", F.col("rn").alias("to"), F.col("pos").alias("far"))
    reach = ranked.withColumn("to", F.col("rn") + least - 1).join(ahead, ["id", "th", "item_id", "to"])
    reach = reach.where(F.col("far") <= F.col("pos") + F.col("size") - 1)
    starts = reach.select("id", "th", "size", F.explode(F.sequence(F.greatest(F.col("pos") - F.col("size") + least, F.lit(0)), F.col("pos"))).alias("start")).distinct()
    # by parts of the document, so that a window is cut from a part and never from a copy of a long document
    step = max(PART, longest)
    wanted = materialize(starts.groupBy("id", "th", F.floor(F.col("start") / step).cast("int").alias("part")).agg(F.collect_list(F.struct("size", "start")).alias("windows")), "decon-windows")

    def parts(sh: Column) -> Column:
        low = lambda p: F.greatest(p * step - longest, F.lit(0))
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(sh) - 1, F.lit(0)) / step).cast("int"))
        return F.struct(F.size(sh).alias("n"), F.transform(numbers, lambda p: F.struct(p.alias("part"), low(p).alias("low"), F.slice(sh, low(p) + 1, step + 2 * longest).alias("sh"))).alias("parts"))

    some = materialize(wanted.select("id", "th").distinct(), "decon-texts")
    there = matching(docs.select(*row_keys(), F.col("text")), ["id", "th"], some, MAX_BROADCAST_ROWS)
    cut = there.select("id", "th", let(shingles(text_of("text")), parts).alias("s")).select("id", "th", F.col("s.n").alias("n"), F.inline("s.parts"))
    cut = cut.join(small_side(wanted, MAX_BROADCAST_ROWS // 10), ["id", "th", "part"]).select("id", "th", "n", "low", "sh", F.explode("windows").alias("w"))
    begin = F.greatest(F.least(F.col("w.start"), F.col("n") - F.col("w.size")), F.lit(0))
    windows = cut.select("id", "th", F.col("w.size").alias("size"), begin.alias("start"), F.slice("sh", begin - F.col("low") + 1, F.col("w.size")).alias("win_sh"))
    windows = materialize(windows.withColumn("fp", simhash(F.col("win_sh"))), "decon-prints")

    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    prints = items.select("item_id", "size", "item_sh", simhash(F.col("item_sh")).alias("item_fp"))
    table = prints.select("item_id", "size", "item_fp", blocks).select("item_id", "size", "item_fp", "block", F.explode(F.transform(F.array(*[F.lit(m) for m in near_values()]), lambda m: _block(F.col("item_fp"), F.col("block")).bitwiseXOR(m))).alias("value"))
    probe = windows.select("id", "th", "size", "start", "fp", blocks).withColumn("value", _block(F.col("fp"), F.col("block")))
    table = small_side(materialize(table, "decon-blocks"), MAX_BROADCAST_ROWS)
    near = probe.join(table, ["size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = near.select("id", "th", "size", "start", "item_id").distinct()
    checked = pairs.join(windows.select("id", "th", "size", "start", "win_sh").distinct(), ["id", "th", "size", "start"]).join(small_side(items.select("item_id", "item_sh"), MAX_BROADCAST_ROWS // 10), "item_id")
    scored = checked.withColumn("similarity", similarity(F.col("win_sh"), F.col("item_sh"))).where(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("id", "th", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "size")).alias("m"))
    return best.select("id", "th", "item_id", (-F.col("m.s")).cast("long").alias("start_word"), F.col("m.size").cast("long").alias("n_shingles"), "m.similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_shingles, similarity): one row for each contaminated row (id and text) and item."""
    found = contaminated_rows(docs, benchmark)
    return found.select(F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), "item_id", "start_word", "n_shingles", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; a null or reused id doesn't decide for other texts."""
    bad = materialize(contaminated_rows(docs, benchmark).select("id", "th").distinct(), "decon-bad")
    return without_rows(docs, list(row_keys()), bad, max_rows=MAX_BROADCAST_ROWS)


_SQL_WORDS = """list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{marks}', ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"""
#: By brute force: every window of a document that holds enough of an item's shingles, compared with it.
ORACLE_SQL = f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS.format(marks=PUNCTUATION.replace("'", "''"))} AS w FROM documents),
bw AS (SELECT item_id, {_SQL_WORDS.format(marks=PUNCTUATION.replace("'", "''"))} AS w FROM benchmark),
d AS MATERIALIZED (SELECT r, doc_id, list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS sh FROM dw),
b AS MATERIALIZED (SELECT item_id, len(sh) AS size, sh FROM (SELECT item_id, list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS sh FROM bw) WHERE len(sh) > 0),
p AS MATERIALIZED (SELECT r, generate_subscripts(sh, 1) - 1 AS pos, unnest(sh) AS h FROM d),
c AS MATERIALIZED (SELECT item_id, size, h, count(*) AS times FROM (SELECT item_id, size, unnest(sh) AS h FROM b) GROUP BY ALL),
pair AS (SELECT r, item_id, size, count(*) AS hits FROM p JOIN c USING (h) GROUP BY ALL HAVING count(*) >= {SIMILARITY} * size),
win AS (SELECT r, item_id, size, unnest(range(0, greatest(len(sh) - size, 0) + 1)) AS start FROM pair JOIN d USING (r)),
near AS (SELECT win.r, win.item_id, win.size, start, p.h, count(*) AS times FROM win JOIN p ON p.r = win.r AND p.pos >= start AND p.pos < start + win.size GROUP BY ALL),
s AS (SELECT r, near.item_id, near.size, start, sum(least(near.times, coalesce(c.times, 0)))::DOUBLE AS m, sum(near.times)::DOUBLE AS n FROM near LEFT JOIN c ON c.item_id = near.item_id AND c.h = near.h GROUP BY ALL),
best AS (SELECT *, m / (n + size - m) AS similarity, row_number() OVER (PARTITION BY r, item_id ORDER BY m / (n + size - m) DESC, start) AS nth FROM s WHERE m / (n + size - m) >= {SIMILARITY})
SELECT doc_id, item_id, start::BIGINT AS start_word, size::BIGINT AS n_shingles, similarity FROM best JOIN d USING (r) WHERE nth = 1
"""
