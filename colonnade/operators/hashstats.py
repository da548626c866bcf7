"""What a chained hash table of given buckets would look like, computed by grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions.integers import bucket


def chains(keys: DataFrame, key: str, initial_buckets: int, capacity: int = 31) -> DataFrame:
    """bucket, records, chain (linked buckets of capacity records) of each first bucket with records."""
    out = keys.groupBy(bucket(F.col(key), initial_buckets).alias("bucket")).agg(F.count("*").alias("records"))
    return out.withColumn("chain", F.ceil(F.col("records") / capacity).cast("long"))


def histogram(keys: DataFrame, key: str, initial_buckets: int, capacity: int = 31) -> DataFrame:
    """chain, buckets: how many first buckets have chains of that length, empty ones (length 0) too."""
    found = chains(keys, key, initial_buckets, capacity)
    used = found.groupBy("chain").agg(F.count("*").alias("buckets"))
    empty = found.agg((F.lit(initial_buckets) - F.count("*")).alias("buckets")).select(F.lit(0).cast("long").alias("chain"), "buckets")
    return used.union(empty).where("buckets > 0")


def statistics(keys: DataFrame, key: str, initial_buckets: int, capacity: int = 31, bucket_bytes: int = 128) -> DataFrame:
    """One row: total_records, buckets (chained ones included), bytes, longest_bucket_chain, longest_record_chain."""
    found = chains(keys, key, initial_buckets, capacity)
    extra = F.coalesce(F.sum(F.col("chain") - 1), F.lit(0))
    return found.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
        (extra + initial_buckets).alias("buckets"),
        ((extra + initial_buckets) * bucket_bytes).alias("bytes"),
        F.coalesce(F.max("chain"), F.lit(0)).alias("longest_bucket_chain"),
        F.coalesce(F.max("records"), F.lit(0)).alias("longest_record_chain"),
    )


def sweep(keys: DataFrame, key: str, initial_buckets: list[int], capacities: list[int], bucket_bytes: int = 128) -> DataFrame:
    """statistics() of every pair of a number of first buckets and a capacity, in one reading of the keys: a row for each pair."""
    hashed = F.array(*(F.struct(F.lit(i).cast("long").alias("initial_buckets"), bucket(F.col(key), i).alias("bucket")) for i in initial_buckets))
    found = keys.select(F.explode(hashed).alias("x")).groupBy("x.initial_buckets", "x.bucket").agg(F.count("*").alias("records"))
    found = found.select("initial_buckets", "records", F.explode(F.array(*(F.lit(c).cast("long") for c in capacities))).alias("capacity"))
    chain = F.ceil(F.col("records") / F.col("capacity")).cast("long")
    total = F.sum(chain - 1) + F.col("initial_buckets")
    return found.groupBy("initial_buckets", "capacity").agg(
        F.sum("records").alias("total_records"), total.alias("buckets"), (total * bucket_bytes).alias("bytes"), F.max(chain).alias("longest_bucket_chain"), F.max("records").alias("longest_record_chain")
    )


def traced(probe: DataFrame, on: str, build: DataFrame, key: str, initial_buckets: int, capacity: int = 31, order: str = "record_index") -> DataFrame:
    """Each probe row with hit, buckets_visited and compares of its lookup; build has unique keys, inserted in the given order.

    Places in a chain are numbered by first bucket, in as many tasks as there are first buckets: give as many of them as the build side is meant to have.
    """
    placed = build.select(F.col(key).alias("_k"), bucket(F.col(key), initial_buckets).alias("_b"), F.col(order).alias("_o"))
    placed = placed.select("_k", "_b", F.row_number().over(Window.partitionBy("_b").orderBy("_o", "_k")).alias("_at"))
    lengths = chains(build, key, initial_buckets, capacity).select(F.col("bucket").alias("_fb"), "records", "chain")
    rows = probe.withColumn("_pb", bucket(F.col(on), initial_buckets))
    rows = rows.join(placed.select("_k", "_at"), F.col(on) == F.col("_k"), "left").join(lengths, F.col("_pb") == F.col("_fb"), "left")
    visited = F.coalesce(F.ceil(F.col("_at") / capacity).cast("long"), F.col("chain"), F.lit(1).cast("long"))
    compares = F.coalesce(F.col("_at").cast("long"), F.col("records"), F.lit(1).cast("long"))
    return rows.select(*probe.columns, F.col("_k").isNotNull().alias("hit"), visited.alias("buckets_visited"), compares.alias("compares"))
