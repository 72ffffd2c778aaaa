"""Fixed-point coordinates.

A value v in [0, 1] becomes round(v * 65534); the sentinel -1 becomes -65534.  Squared distances are
then sums of integer squares: exact, independent of order, equal in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 65534
COORDINATES = tuple(f"c{i}" for i in range(14))


def pack(value: Column) -> Column:
    return F.when(value == -1, F.lit(-SCALE).cast("long")).otherwise(F.round(F.coalesce(value, F.lit(0.0)) * SCALE).cast("long"))


def unpack(coordinate: Column) -> Column:
    return F.when(coordinate < 0, F.lit(-1.0)).otherwise(coordinate / float(SCALE))


def pack_columns(vector: Column, names: tuple[str, ...] = COORDINATES) -> list[Column]:
    return [pack(F.get(vector, F.lit(i))).alias(n) for i, n in enumerate(names)]


def is_fraud(label: Column) -> Column:
    return (label == "fraud").cast("int")
