"""The same operators over an unbounded table, under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files under path, with the columns of a table like it."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def generated(spark: SparkSession, rows_per_second: int = 1000) -> DataFrame:
    """record_index and ts, without end."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("record_index"), F.col("timestamp").alias("ts"))


def window_totals(events: DataFrame, ts: str, group: str, column: str, every: str = "1 hour", late: str = "2 hours", predicate: Column | None = None) -> DataFrame:
    """start, group, n, total by time window; rows later than the watermark are dropped, and state behind it is freed."""
    rows = (events if predicate is None else events.where(predicate)).withColumn(ts, F.col(ts).cast("timestamp"))
    out = rows.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), F.col(group).alias("group")).agg(F.count("*").alias("n"), F.sum(column).alias("total"))
    return out.select(F.col("w.start").alias("start"), "group", "n", "total")


def write(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Starts writing Parquet; with once, all that is there now, and then it ends. The checkpoint makes a restart carry on exactly."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
