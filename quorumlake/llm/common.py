"""Shared pieces of the training-data operators: intermediate tables, words, row keys.

Conventions that hold for every operator of this package:

* an operator selects the columns it needs into private names first, so extra input columns,
  whatever their names, can't clash with what it computes;
* a null text counts as the empty text;
* intermediate tables are Parquet in the folder that ``spark.checkpoint.dir`` names, so a lost
  executor costs only the tasks it ran.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words, as a Java character class.
SPACE = "[\\x20\\x09-\\x0D]"
#: The same for ``translate``.
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Spark's setting by which a query's shuffle files go with its end.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, where none is set, a temporary one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="quorumlake-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage.

    The shuffle files of the write go when it is done, not when the driver's JVM collects its plan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREED, before)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_.table_path = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` of which nothing that is still to run reads."""
    for t in tables:
        spark, path = t.sparkSession, getattr(t, "table_path", None)
        if path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sliced(batches, rows: int = 512):
    """Arrow batches in small parts, since rows take several times their size as Python objects."""
    for b in batches:
        for i in range(0, max(b.num_rows, 1), rows):
            yield b.slice(i, rows)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint when the (materialised) table has at most ``max_rows`` rows, else none."""
    return F.broadcast(df) if df.count() <= max_rows else df


#: Bits of a bitmap: 16 MB whatever the size of the table it is made of.
FILTER_BITS = 1 << 27


def bitmap(values: DataFrame, column: str) -> DataFrame:
    """A bitmap with a bit for each value of the whole numbers ``column``, as rows (m__, words) of 1,024 words of 32 bits."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    maps = values.groupBy(F.bitmap_bucket_number(bit).alias("m__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("map"))
    word = lambda i: F.conv(F.hex(F.substring(F.col("map"), i * 4 + 1, F.lit(4))), 16, 10).cast("long")
    signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")
    words = F.transform(F.transform(F.sequence(F.lit(0), F.lit(1023)), word), signed)
    return materialize(maps.select("m__", words.alias("words")), "bitmaps")


def tested(rows: DataFrame, column: str, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``column`` a bitmap may hold (all that it holds and a few by chance), and those that it can't hold."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    place = F.bitmap_bit_position(bit).cast("int")
    # a word holds four bytes, the first one highest; a byte's bits count from its lowest
    shift = (3 - F.floor(place / 8).cast("int") % 4) * 8 + place % 8
    word = F.get(F.col("words"), F.call_function("shiftright", place, F.lit(5)))
    hit = F.coalesce(F.call_function("shiftrightunsigned", word, shift).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    marked = rows.withColumn("b__", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), F.col("b__") == F.col("m__"), "left")
    cut = lambda cond: marked.where(cond).select(*rows.columns)
    return cut(hit), cut(~hit)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once even where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Words are maximal runs of characters other than the six ASCII white-space bytes."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


NO_ID = -(2**63)


def row_keys() -> tuple[Column, Column]:
    """A row of documents by its id and its text's hash: rows that agree in both are copies of one row."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_of("text")).alias("th")


def matching(rows: DataFrame, names: list[str], side: DataFrame, max_rows: int) -> DataFrame:
    """``rows`` whose columns ``names`` are in ``side``; beyond the bound only rows that a bitmap of the last one marks are shuffled."""
    if side.count() <= max_rows:
        return rows.join(F.broadcast(side), names, "left_semi")
    return tested(rows, names[-1], bitmap(side, names[-1]))[0].join(side, names, "left_semi")


def without_rows(docs: DataFrame, keys: list[Column], gone: DataFrame, once: DataFrame | None = None, max_rows: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose ``keys`` are in ``gone``, and with one row for each of ``once``; columns unchanged.

    ``gone`` and ``once`` are materialised and have one column for each key, in order; the last key is a hash.
    """
    names = [f"k_{i}__" for i in range(len(keys))]
    inner = [f"in_{i}__" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, inner, strict=True)], *[k.alias(n) for k, n in zip(keys, names, strict=True)])

    def without(rows: DataFrame, side: DataFrame) -> DataFrame:
        """Beyond the bound only rows that a bitmap of the last key marks are shuffled, texts and all."""
        if side.count() <= max_rows:
            return rows.join(F.broadcast(side), names, "left_anti")
        maybe, surely = tested(rows, names[-1], bitmap(side, names[-1]))
        return maybe.join(side, names, "left_anti").unionByName(surely)

    kept = without(named, gone.toDF(*names))
    if once is not None and not once.isEmpty():
        side = once.toDF(*names)
        single = matching(kept, names, side, max_rows).dropDuplicates(names)
        kept = without(kept, side).unionByName(single)
    return kept.select(*[F.col(a).alias(c) for c, a in zip(docs.columns, inner, strict=True)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
