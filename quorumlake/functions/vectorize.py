"""The 14-dimension vector of a request, as column expressions.

Absent numbers and flags count as zero and false.  A null ``last_transaction`` gives the sentinel -1
in dimensions 5 and 6.  A customer average of zero has no ratio: the row gets an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config

ZERO_TIME = "0001-01-01 00:00:00"
AVG_ERROR = "no ratio to a customer average of 0"


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int").cast("double")


def mcc_risk(mcc: Column, config: Config) -> Column:
    """Risk of a category: a literal map, a few entries by construction."""
    if not config.mcc_risk:
        return F.lit(config.default_risk)
    known = F.create_map(*[F.lit(v) for k, r in config.mcc_risk.items() for v in (k, float(r))])
    return F.coalesce(F.element_at(known, mcc), F.lit(config.default_risk))


def unknown_merchant(known: Column, merchant: Column) -> Column:
    has = F.exists(F.coalesce(known, F.array().cast("array<string>")), lambda m: m.eqNullSafe(F.coalesce(merchant, F.lit(""))))
    return F.when(has, 0.0).otherwise(1.0)


def dimensions(config: Config, request: str | None = None) -> list[Column]:
    """The 14 expressions over request columns (or over the fields of the struct column ``request``)."""
    n = config.normalization
    at = lambda path: F.col(f"{request}.{path}" if request else path)
    num = lambda path: F.coalesce(at(path).cast("double"), F.lit(0.0))
    when = F.coalesce(at("transaction.requested_at"), F.lit(ZERO_TIME).cast("timestamp_ntz"))
    before = F.coalesce(at("last_transaction.timestamp"), F.lit(ZERO_TIME).cast("timestamp_ntz"))
    minutes = F.timestamp_diff("MICROSECOND", before, when) / 60000000.0
    first = at("last_transaction").isNull()
    ratio = F.try_divide(num("transaction.amount"), num("customer.avg_amount"))
    return [
        clamp(num("transaction.amount") / n.max_amount),
        clamp(num("transaction.installments") / n.max_installments),
        F.when(ratio.isNotNull(), clamp(ratio / n.amount_vs_avg_ratio)),
        F.hour(when) / 23.0,
        F.weekday(when) / 6.0,
        F.when(first, -1.0).otherwise(clamp(minutes / n.max_minutes)),
        F.when(first, -1.0).otherwise(clamp(num("last_transaction.km_from_current") / n.max_km)),
        clamp(num("terminal.km_from_home") / n.max_km),
        clamp(num("customer.tx_count_24h") / n.max_tx_count_24h),
        flag(at("terminal.is_online")),
        flag(at("terminal.card_present")),
        unknown_merchant(at("customer.known_merchants"), at("merchant.id")),
        mcc_risk(at("merchant.mcc"), config),
        clamp(num("merchant.avg_amount") / n.max_merchant_avg_amount),
    ]


def vectorize(requests: DataFrame, config: Config | None = None, keep: tuple[str, ...] = ("id",), request: str | None = None) -> DataFrame:
    """(keep..., v0..v13, error)."""
    dims = dimensions(config or Config(), request)
    df = requests.select(*keep, *[d.alias(f"v{i}") for i, d in enumerate(dims)])
    return df.withColumn("error", F.when(F.col("v2").isNull(), AVG_ERROR))


def vector_of(df: DataFrame) -> Column:
    return F.array(*[F.col(f"v{i}") for i in range(14)])
