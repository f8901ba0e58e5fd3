"""Repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_delivery(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key, the earliest delivered; a row without time comes first.

    Aggregated before the shuffle. Ties are settled by the values of the row.
    """
    rest = [c for c in df.columns if c not in (key, at)]
    row = F.struct(*rest)
    return df.groupBy(key).agg(F.min(F.struct(F.col(at).alias("at"), row.alias("row"))).alias("m")).select(key, F.col("m.at").alias(at), *[F.col(f"m.row.{c}").alias(c) for c in rest]).select(*df.columns)
