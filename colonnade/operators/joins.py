"""Joins of a large table with a build side of unique keys.

The build side is hinted for broadcast only where its size is known to be small: by the size that Spark has for it, or for the base
table that it keeps no more rows of. Else the join is left to adaptive execution, which measures and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a build side is broadcast.
BROADCAST_BYTES = 64 << 20


def size_in_bytes(df: DataFrame) -> int:
    """Spark's estimate for the plan: for a scan, what its files hold."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def build_side(build: DataFrame, base: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """build, hinted for broadcast if it, or the base whose rows it is drawn from, is within limit."""
    small = (base is not None and size_in_bytes(base) <= limit) or size_in_bytes(build) <= limit
    return F.broadcast(build) if small else build


def unique_build(df: DataFrame, key: str, *payload: str, order: str = "record_index", check: bool = False) -> DataFrame:
    """One row for each key: that of the least order, as a chained table finds it. With check, a repeated key raises instead."""
    if check:
        out = df.groupBy(key).agg(F.count("*").alias("n"), *(F.first(p).alias(p) for p in payload))
        return out.where(F.assert_true(F.col("n") == 1, F.lit("the build side has a key twice")).isNull()).select(key, *payload)
    return df.groupBy(key).agg(*(F.min_by(p, order).alias(p) for p in payload)) if payload else df.select(key).distinct()


def semi(probe: DataFrame, build: DataFrame, on: str, key: str, mask: Column | None = None) -> DataFrame:
    """The probe rows (of the mask) whose on is a key of build."""
    probe = probe if mask is None else probe.where(mask)
    return probe.join(build.select(F.col(key).alias("_k")), F.col(on) == F.col("_k"), "left_semi")


def semi_flags(probe: DataFrame, unique: DataFrame, on: str, key: str, mask: Column | None = None, name: str = "sel") -> DataFrame:
    """Every probe row, with a boolean column: in the mask, and on is a key of unique (which has each key once)."""
    marked = unique.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    joined = probe.join(marked, F.col(on) == F.col("_k"), "left")
    return joined.withColumn(name, hit if mask is None else hit & F.coalesce(mask, F.lit(False))).drop("_k", "_hit")


def payload_join(probe: DataFrame, unique: DataFrame, on: str, key: str, mask: Column | None = None) -> DataFrame:
    """Probe rows that hit, with the payload columns of unique."""
    probe = probe if mask is None else probe.where(mask)
    return probe.join(unique, F.col(on) == F.col(key)).drop(key)


def index_join(probe: DataFrame, build: DataFrame, on: str, key: str, mask: Column | None = None) -> DataFrame:
    """Positions of the hits."""
    return semi(probe, build, on, key, mask).select("record_index")


def index_payload_join(probe: DataFrame, unique: DataFrame, on: str, key: str, payload: str, mask: Column | None = None) -> DataFrame:
    """Position and payload of the hits."""
    return payload_join(probe, unique, on, key, mask).select("record_index", F.col(payload).alias("payload"))


def lookup(keys: DataFrame, unique: DataFrame, on: str, key: str, payload: str) -> DataFrame:
    """Every key with its payload, null where the table lacks the key."""
    return keys.join(unique.select(F.col(key).alias("_k"), F.col(payload).alias("payload")), F.col(on) == F.col("_k"), "left").drop("_k")
