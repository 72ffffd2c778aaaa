"""Labelled reference vectors: JSON scan, validation, packing, Parquet store, JSON export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packing import COORDINATES, is_fraud, pack_columns, unpack
from .schemas import DIMENSIONS, LABELS, REFERENCE_STRUCT, SENTINEL_DIMENSIONS


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """The reference file: one JSON array of {vector, label}, gzip or plain, to (ref_id, vector, label); ref_id is the place.

    The text is read as records that end with ``}``, so memory doesn't grow with the file.  A gzip file
    isn't splittable and is one task; a plain file is read in splits, whose counts, taken first, number the
    records.  Anything but a single array of objects is an error: the first record follows ``[``, each
    other one a comma, and ``]`` alone comes after the last.
    """
    lines = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()  # one row a split
    held = sorted((b.block, b.n, b.first) for b in blocks)
    total = sum(n for _, n, _ in held)
    if len({b.file for b in blocks}) > 1:
        raise ValueError("references come from one file")
    if total == 0:
        nothing = F.raise_error(F.lit("references must be exactly one JSON array of objects, and the file is empty"))
        return spark.range(1).select(nothing.cast("long").alias("ref_id"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("label"))
    starts = [(block, first, sum(n for _, n, _ in held[:i])) for i, (block, n, first) in enumerate(held)]
    offsets = F.broadcast(spark.createDataFrame(starts, "block long, first long, start long"))
    placed = lines.join(offsets, "block").select("value", (F.col("at") - F.col("first") + F.col("start")).alias("place"))
    text, broken = F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")), F.raise_error(F.lit("references must be exactly one JSON array of objects"))
    opening = F.when(F.col("place") == 0, "[").otherwise(",")
    end = F.col("place") == total - 1
    closed = text.rlike(r"^\[\s*\]$") if total == 1 else text == "]"
    item = F.concat(F.ltrim(F.regexp_replace(F.substring(text, 2, 1 << 30), r"^\s+", "")), F.lit("}"))
    whole = text.startswith(opening) & item.startswith("{")
    record = F.from_json(F.when(end & closed, F.lit(None)).when(end | ~whole, broken.cast("string")).otherwise(item), REFERENCE_STRUCT, {"mode": "FAILFAST"})
    parsed = placed.select(F.col("place").alias("ref_id"), record.alias("r"), end.alias("end"))
    # the last record is no reference, but it is checked as the others are
    return parsed.where(~F.col("end") | F.col("r").isNotNull()).select("ref_id", "r.vector", "r.label")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """A splittable alternative: one {ref_id, vector, label} on each line."""
    return spark.read.schema("ref_id long, vector array<double>, label string").option("mode", "FAILFAST").json(path)


def problem(vector: Column, label: Column) -> Column:
    """Why a reference is invalid, or null.  Null elements of a vector count as 0."""
    at = lambda i: F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0))
    inside = lambda x: (x >= 0) & (x <= 1) & ~F.isnan(x)
    ok = F.lit(True)
    for i in range(DIMENSIONS):
        ok = ok & ((inside(at(i)) | (at(i) == -1)) if i in SENTINEL_DIMENSIONS else inside(at(i)))
    return (
        F.when(vector.isNull() | (F.size(vector) != DIMENSIONS), "dimensions")
        .when(~ok, "values")
        .when(label.isNull() | ~label.isin(*LABELS), "label")
    )


def validate(references: DataFrame, fail: bool = True) -> DataFrame:
    """Adds ``problem``; with ``fail`` the first bad row that is read ends the query instead."""
    df = references.withColumn("problem", problem(F.col("vector"), F.col("label")))
    if not fail:
        return df
    stop = F.raise_error(F.concat(F.lit("reference "), F.col("ref_id").cast("string"), F.lit(": invalid "), F.col("problem")))
    return df.withColumn("label", F.when(F.col("problem").isNotNull(), stop).otherwise(F.col("label"))).drop("problem")


def pack(references: DataFrame) -> DataFrame:
    """(ref_id, c0..c13, fraud) from (ref_id, vector, label)."""
    return references.select("ref_id", *pack_columns(F.col("vector")), is_fraud(F.col("label")).alias("fraud"))


def write_store(packed: DataFrame, path: str) -> None:
    packed.write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def point(store: DataFrame, ref_id: int) -> DataFrame:
    """One packed row; an id out of range gives no row.  The filter reaches the Parquet scan."""
    return store.where(F.col("ref_id") == ref_id)


def export(store: DataFrame) -> DataFrame:
    """Decoded references (ref_id, vector, label)."""
    return store.select("ref_id", F.array(*[unpack(F.col(c)) for c in COORDINATES]).alias("vector"), F.when(F.col("fraud") == 1, "fraud").otherwise("legit").alias("label"))


def write_json_array(references: DataFrame, path: str) -> None:
    """(ref_id, vector, label) as one JSON array in id order; one file, so one task writes it."""
    last = references.agg(F.max("ref_id")).first()[0]
    item = F.to_json(F.struct("vector", "label"))
    first = F.col("ref_id") == references.agg(F.min("ref_id")).first()[0]
    line = F.concat(F.when(first, "[").otherwise(""), item, F.when(F.col("ref_id") == last, "]").otherwise(","))
    references.select("ref_id", line.alias("value")).repartition(1).sortWithinPartitions("ref_id").select("value").write.option("compression", "gzip").text(path)
