"""Values of selected rows: of another column, or by way of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.operators.joins import lookup


def values(df: DataFrame, predicate: Column, *columns: str, ordered: bool = False) -> DataFrame:
    """The columns at the selected positions; in order of record_index if asked for."""
    rows = df.where(predicate)
    return (rows.orderBy("record_index") if ordered else rows).select(*columns)


def payloads(df: DataFrame, predicate: Column, unique: DataFrame, on: str, key: str, payload: str) -> DataFrame:
    """record_index and payload of the selected rows; a key that the table lacks raises."""
    table = unique.withColumn("_there", F.lit(1)).select(key, F.struct(payload, "_there").alias("p"))
    rows = lookup(df.where(predicate), table, on, key, "p")
    there = F.assert_true(F.col("payload").isNotNull(), F.concat(F.lit("no payload for key "), F.col(on).cast("string"))).isNull()
    return rows.where(there).select("record_index", F.col(f"payload.{payload}").alias("payload"))
