"""Deterministic columns and record sets over spark.range; a value depends on its row and the seed, not on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def constant(value: int) -> Column:
    return F.lit(value).cast("long")


def incremental(width: int, start: int = 0, index: str = "record_index") -> Column:
    """start + index, wrapping at 2^(8 width)."""
    return F.pmod(F.col(index) + start, F.lit(1 << (8 * width)))


def uniform(low: int, high: int, seed: int = 0, index: str = "record_index") -> Column:
    """low to high, both included. Seed 0 is a seed like any other."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(index)), F.lit(high - low + 1)) + F.lit(low)


def uniform_width(width: int, seed: int = 0, index: str = "record_index") -> Column:
    """All values of width bytes (7 at most)."""
    return uniform(0, (1 << (8 * width)) - 1, seed, index)


def records(spark: SparkSession, n: int, pi: Column | None = None, data: Column | None = None) -> DataFrame:
    """(record_index, pi, data); a column not given is null."""
    null = F.lit(None).cast("long")
    rows = spark.range(n).withColumnRenamed("id", "record_index")
    return rows.select("record_index", (null if pi is None else pi).alias("pi"), (null if data is None else data).alias("data"))


#: The usual pairs of key and data columns, as functions of (width, low, high, value, seed).
COMBINATIONS = {
    "random_constant": lambda width, low, high, value, seed: (uniform_width(width, seed), constant(value)),
    "incremental_constant": lambda width, low, high, value, seed: (incremental(width), constant(value)),
    "random_null": lambda width, low, high, value, seed: (uniform_width(width, seed), None),
    "incremental_null": lambda width, low, high, value, seed: (incremental(width), None),
    "bounded_null": lambda width, low, high, value, seed: (uniform(low, high, seed), None),
    "constant_random": lambda width, low, high, value, seed: (constant(value), uniform_width(width, seed)),
    "incremental_random": lambda width, low, high, value, seed: (incremental(width), uniform_width(width, seed)),
}


def combination(spark: SparkSession, name: str, n: int, width: int = 4, low: int = 0, high: int = 255, value: int = 0xCC, seed: int = 1) -> DataFrame:
    pi, data = COMBINATIONS[name](width, low, high, value, seed)
    return records(spark, n, pi, data)


def sqb_tables(spark: SparkSession, n_a: int, n_b: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """A and B of the select-join-aggregate suite, generated."""
    i = "record_index"
    a = spark.range(n_a).withColumnRenamed("id", i)
    a = a.select(i, F.col(i).alias("a_k"), uniform(0, max(n_b, 1) - 1, seed).alias("a_b_k"), uniform(0, 9, seed + 1).alias("a_10"), uniform(0, 99, seed + 2).alias("a_100"))
    b = spark.range(n_b).withColumnRenamed("id", i)
    return a, b.select(i, F.col(i).alias("b_k"), uniform(0, 9, seed + 3).alias("b_10"), uniform(0, 99, seed + 4).alias("b_100"))
