"""Sums and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total(df: DataFrame, column: str, sum_bytes: int | None = None) -> DataFrame:
    """One row with the exact sum, or the sum modulo 2^(8 sum_bytes); 0 for no rows."""
    s = F.coalesce(F.sum(F.col(column).cast("long")), F.lit(0))
    return df.agg((s if sum_bytes is None else F.pmod(s, F.lit(1 << (8 * sum_bytes)))).alias("total"))


def group_total(df: DataFrame, group: str, column: str, dense: int | None = None) -> DataFrame:
    """group, total; with dense, all groups from 0 to dense - 1, those without rows at 0."""
    out = df.groupBy(F.col(group).cast("long").alias("group")).agg(F.sum(F.col(column).cast("long")).alias("total"))
    if dense is None:
        return out
    every = df.sparkSession.range(dense).select(F.col("id").alias("g"))
    return every.join(out, F.col("g") == F.col("group"), "left").select(F.col("g").alias("group"), F.coalesce("total", F.lit(0)).alias("total"))
