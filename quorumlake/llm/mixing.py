"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources in code point order (null last) weigh 5, 2, 1, repeating, and share the total
number of words; a target stops at ``MAX_EPOCHS`` times its source's size and the excess is reshared
by weight (water-filling: one pass over the sources in the order in which they fill up).

A source first takes whole epochs.  What is left of its target is a sample without replacement:
each document has the key -ln(u) / w, with u from a hash of its row and the quality weight w (the
share of its word characters that aren't markup symbols), and the documents of smallest key are
taken until the prefix sum of their words meets the budget; the last one only if that comes nearer.

The prefix sum is never taken over a whole source in one task: words are summed by fine key ranges
first, the range that holds the budget is found on those sums, and only that range is sorted.  The
outcome is one threshold for each source.

Defined cases: null and empty texts have size 0 and are taken 0 words; a null source is a source
of its own; rows are told apart by id, source and text, so null and reused ids are drawn each on
its own, and copies of one row are numbered and drawn each on its own too; reruns agree since u is a
hash and ties are broken by (row hash, copy number); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, materialize, small_side, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
RANGES = 1 << 14
SYMBOLS = "#*$%&|<>!"
MAX_BROADCAST_SOURCES = 100_000
MAX_BROADCAST_ROWS = 1_000_000
#: Copies of one row that one task gives out at once.
CHUNK = 10_000


def n_words(text: Column) -> Column:
    return F.when(F.translate(text, SPACE_CHARS, "") == "", 0).otherwise(F.size(F.split(F.trim(text, F.lit(SPACE_CHARS)), SPACE + "+"))).cast("long")


def quality_weight(text: Column) -> Column:
    chars = F.length(F.translate(text, SPACE_CHARS, ""))
    plain = F.length(F.translate(text, SPACE_CHARS + SYMBOLS, ""))
    return F.greatest(F.coalesce(F.try_divide(plain.cast("double"), chars), F.lit(1.0)), F.lit(0.1))


def row_hash(doc_id: Column, source: Column, text: Column) -> Column:
    """128 bits of what tells rows apart here: id, source and text."""
    part = lambda mark, c: F.coalesce(F.concat(F.lit(mark), c.cast("string")), F.lit("null"))
    return F.md5(F.concat_ws(":", part("i", doc_id), part("s", source), F.md5(text)))


def sampling_key(row: Column, copy: Column, weight: Column, seed: int) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), row, copy.cast("string"))), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 48)) / weight


def _range(key: Column) -> Column:
    return F.floor((1 - F.exp(-key / 2)) * RANGES).cast("int")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size), one row each, to (source, source_size, target)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    w = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(WEIGHTS))).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(everything) - before) / after)
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("fills"), "level"))).over(everything)["level"])
    return w.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def plan(keyed: DataFrame) -> DataFrame:
    """``keyed`` (source, size, key, row, copy) to one row for each source: what to take of it.

    (source, source_size, target, epochs, cut_range, cut): a document is taken once more than
    ``epochs`` if its key range is below ``cut_range`` or, in it, (key, row, copy) is at most ``cut``.
    """
    sums = materialize(keyed.groupBy("source", _range(F.col("key")).alias("range")).agg(F.sum("size").alias("words")), "mix-ranges")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    epochs = F.least(F.lit(MAX_EPOCHS), F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)) + 1e-9)).cast("int")
    targets = materialize(targets.withColumn("epochs", epochs).withColumn("budget", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))), "mix-targets")
    upto = Window.partitionBy("source").orderBy("range")
    ends = sums.withColumn("upto", F.sum("words").over(upto)).join(targets.select(F.col("source").alias("s"), "budget"), F.expr("source <=> s")).drop("s")
    ends = ends.where(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("range", "upto", "words", "budget")).alias("at"))
    cut = materialize(ends.select("source", F.col("at.range").alias("cut_range"), (F.col("at.budget") - F.col("at.upto") + F.col("at.words")).alias("left")), "mix-cuts")
    inside = keyed.join(small_side(cut.select(F.col("source").alias("s"), "cut_range", "left"), MAX_BROADCAST_SOURCES), F.expr("source <=> s") & (_range(F.col("key")) == F.col("cut_range")))
    inside = inside.withColumn("sum", F.sum("size").over(Window.partitionBy("s").orderBy("key", "row", "copy").rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.where(F.col("sum") - F.col("size") / 2 <= F.col("left")).groupBy("s").agg(F.max(F.struct("key", "row", "copy")).alias("cut"))
    full = targets.join(cut.select(F.col("source").alias("c"), "cut_range"), F.expr("source <=> c"), "left").join(last, F.expr("source <=> s"), "left")
    return materialize(full.select("source", "source_size", "target", "epochs", F.coalesce("cut_range", F.lit(RANGES + 1)).alias("cut_range"), "cut"), "mix-plan")


def copies(key: Column, row: Column, copy: Column) -> Column:
    """How often the mix takes a document, from the plan's columns beside it."""
    below = F.struct(key.alias("key"), row.alias("row"), copy.alias("copy")) <= F.col("cut")
    more = (_range(key) < F.col("cut_range")) | ((_range(key) == F.col("cut_range")) & F.coalesce(below, F.lit(False)))
    return F.col("epochs") + F.when((F.col("epochs") < MAX_EPOCHS) & more, 1).otherwise(0)


def _repeated(rows: DataFrame, first: Column, times: Column) -> DataFrame:
    """Each of ``rows`` once for each number ``copy`` from ``first``, ``times`` in all; large counts are dealt in chunks."""
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / CHUNK).cast("long"))).alias("chunk__")
    dealt = rows.select("*", first.cast("long").alias("first__"), times.cast("long").alias("times__")).where("times__ > 0").select("*", chunks)
    dealt = dealt.where("times__ <= 1").unionByName(dealt.where("times__ > 1").repartition("chunk__", *rows.columns[:1]))
    low = F.col("chunk__") * CHUNK
    numbers = F.explode(F.sequence(F.col("first__") + low, F.col("first__") + F.least(low + CHUNK, F.col("times__")) - 1)).alias("copy")
    return dealt.select(*rows.columns, numbers)


def _groups(docs: DataFrame) -> DataFrame:
    """Equal rows (id, source and text) counted: (row, doc_id, source, size, weight, times)."""
    text, id_, source = text_of("text"), F.col("doc_id").cast("long"), F.col("source").cast("string")
    rows = docs.select(row_hash(id_, source, text).alias("row"), id_.alias("doc_id"), source.alias("source"), n_words(text).alias("size"), quality_weight(text).alias("weight"))
    return materialize(rows.groupBy("row", "doc_id", "source", "size", "weight").agg(F.count("*").alias("times")), "mix-rows")


def _keyed(groups: DataFrame, seed: int) -> DataFrame:
    """One row (row, copy, doc_id, source, size, key) for each document: copies of one row have keys of their own."""
    single = groups.where("times = 1").select("*", F.lit(0).cast("long").alias("copy"))
    several = _repeated(groups.where("times > 1"), F.lit(0), F.col("times"))
    return single.unionByName(several).select("row", "copy", "doc_id", "source", "size", sampling_key(F.col("row"), F.col("copy"), F.col("weight"), seed).alias("key"))


def _planned(groups: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    keyed = materialize(_keyed(groups, seed), "mix-keys")
    return keyed, small_side(plan(keyed).withColumnRenamed("source", "plan_source"), MAX_BROADCAST_SOURCES)


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source)."""
    keyed, to = _planned(_groups(docs), seed)
    df = keyed.join(to, F.expr("source <=> plan_source"))
    return df.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies(F.col("key"), F.col("row"), F.col("copy"))).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns unchanged.

    Rows equal in id, source and text are numbered in the order of a hash of their other columns; the
    rows that agree in those as well are interchangeable, so one of them stands for all it takes.
    """
    groups = _groups(docs)
    _, to = _planned(groups, seed)
    inner = {f"in_{i}": c for i, c in enumerate(docs.columns)}
    others = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")]
    source, text = F.col("source").cast("string"), text_of("text")
    named = docs.select(*[F.col(f"`{c}`").alias(a) for a, c in inner.items()], row_hash(F.col("doc_id").cast("long"), source, text).alias("m_row"), source.alias("m_source"), quality_weight(text).alias("m_weight"), (F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")).alias("m_rest"))
    taken = lambda rows, copy: copies(sampling_key(F.col("m_row"), copy, F.col("m_weight"), seed), F.col("m_row"), copy)
    out = lambda rows: rows.select(*[F.col(a).alias(c) for a, c in inner.items()])

    def once_each(rows: DataFrame) -> DataFrame:
        first = F.lit(0).cast("long")
        times = rows.join(to, F.expr("m_source <=> plan_source")).withColumn("m_times", taken(rows, first)).where("m_times > 0")
        return out(times.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_times")))))

    again = materialize(groups.where("times > 1").select(F.col("row").alias("m_row")), "mix-repeated")
    if again.isEmpty():
        return once_each(named)
    side = small_side(again, MAX_BROADCAST_ROWS)
    several = named.join(side, "m_row", "left_semi")
    counts = materialize(several.groupBy("m_row", "m_source", "m_weight", "m_rest").agg(F.count("*").alias("times")), "mix-variants")
    bucket = F.call_function("shiftright", F.col("m_rest"), F.lit(50)).alias("bucket")
    buckets = counts.groupBy("m_row", bucket).agg(F.sum("times").alias("held"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    start = buckets.select("m_row", "bucket", F.coalesce(F.sum("held").over(before("m_row").orderBy("bucket")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("times").over(before("m_row", "bucket").orderBy("m_rest")), F.lit(0))
    numbered = counts.withColumn("bucket", bucket).join(start, ["m_row", "bucket"]).withColumn("first", F.col("start") + inside)
    each = _repeated(numbered.select("m_row", "m_source", "m_weight", "m_rest", "first", "times"), F.col("first"), F.col("times")).join(to, F.expr("m_source <=> plan_source"))
    total = materialize(each.groupBy("m_row", "m_rest").agg(F.sum(taken(each, F.col("copy"))).cast("long").alias("m_times")).where("m_times > 0"), "mix-taken")
    stand_in = several.dropDuplicates(["m_row", "m_rest"]).join(total, ["m_row", "m_rest"])
    return once_each(named.join(side, "m_row", "left_anti")).unionByName(out(_repeated(stand_in, F.lit(0), F.col("m_times"))))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    md5(coalesce('i' || doc_id::VARCHAR, 'null') || ':' || coalesce('s' || source, 'null') || ':' || md5(coalesce(text, ''))) AS row FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY row) - 1 AS copy FROM d),
k AS (
  SELECT doc_id, source, row, copy, len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))::BIGINT AS size,
    -ln((('0x' || substr(md5('7:' || row || ':' || copy::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / {float(1 << 48)}::DOUBLE)
      / greatest(coalesce(length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r#*$%&|<>!]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]', '', 'g')), 0), 1::DOUBLE), 0.1::DOUBLE) AS key
  FROM n),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight, source_size * {MAX_EPOCHS} AS cap FROM s),
f AS (SELECT *, cap / weight AS fills,
    ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT level FROM f WHERE level <= fills ORDER BY fills, level LIMIT 1),
g AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM l) * weight, cap::DOUBLE)) AS target FROM f),
e AS (SELECT *, least({MAX_EPOCHS}, floor(coalesce(target / nullif(source_size, 0), 0) + 1e-9))::INT AS epochs FROM g),
c AS (SELECT k.*, e.source_size, e.target, e.epochs, greatest(e.target - e.epochs * e.source_size, 0) AS budget,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, row, copy ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN epochs < {MAX_EPOCHS} AND upto - size / 2 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
