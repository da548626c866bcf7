"""Tables from Parquet and pipe-separated files, and the text forms of results and record sets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.sources.schema import SSB, TABLES


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; with a known schema no file is opened before the query runs."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def tbl(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A star-schema table from pipe-separated text; a trailing separator is allowed."""
    return spark.read.csv(path, sep="|", schema=SSB[name], header=False)


def encode(column: Column, domain: list[str]) -> Column:
    """The code of a string, its place in the domain; null for a string outside it. Codes keep the domain's order."""
    codes = F.create_map(*(x for i, v in enumerate(domain) for x in (F.lit(v), F.lit(i))))
    return F.try_element_at(codes, column)


def decode(column: Column, domain: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, domain)), column)


def write_records(df: DataFrame, path: str, widths: tuple[int, int] = (4, 4)) -> None:
    """(record_index, pi, data) as text: a line with the widths and the count between tabs, then a line for each record in order.

    Written by one task in order: a format for fixtures. Large tables go to Parquet.
    """
    n = df.count()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = df.sparkSession.range(1).select(F.lit(-1).cast("long").alias("i"), F.lit(f"{widths[0]}\t{widths[1]}\t{n}").alias("value"))
    body = df.select(F.col("record_index").cast("long").alias("i"), F.concat_ws(" ", text("pi"), text("data")).alias("value"))
    head.union(body).repartition(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_index, pi, data) from that text; raises if the count in its first line is not that of the records."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\n+$", ""), "\n").alias("lines"))
    n = F.size("lines") - 1
    declared = F.try_element_at(F.split(F.element_at("lines", 1), "\t"), F.lit(3)).try_cast("int")
    checked = lines.where(F.assert_true(F.coalesce(declared == n, F.lit(False)), F.lit("not a record file, or its count is wrong")).isNull())
    rows = checked.select(F.posexplode(F.slice("lines", 2, n)).alias("record_index", "line")).select(F.col("record_index").cast("long"), F.split("line", " ").alias("x"))
    number = lambda k: F.when(F.col("x")[k] != "None", F.col("x")[k].cast("long"))
    return rows.select("record_index", number(0).alias("pi"), number(1).alias("data"))


def write_positions(selected: DataFrame, path: str) -> None:
    """Positions of a selection as Parquet (record_index), sorted within files."""
    selected.sortWithinPartitions("record_index").write.mode("overwrite").parquet(path)


def write_table(build: DataFrame, path: str) -> None:
    """A build side as JSON lines: key and payload."""
    build.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_settings(settings: dict, path: str) -> None:
    """Settings of a layout or a cost model."""
    with open(path, "w") as f:
        json.dump(settings, f, indent=2)


def load_settings(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
