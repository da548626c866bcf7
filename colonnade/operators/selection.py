"""Selections of rows: as a boolean column, as a list of positions, and as bitmaps of 32,768 positions each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions in one bitmap.
SPAN = 32768


def select(df: DataFrame, predicate: Column, prior: Column | None = None) -> DataFrame:
    """The rows that predicate picks from those of the prior selection."""
    return df.where(predicate if prior is None else prior & predicate)


def flags(df: DataFrame, predicate: Column, prior: Column | None = None, name: str = "sel") -> DataFrame:
    """Every row, with the selection as a boolean column; a null counts as not selected."""
    picked = predicate if prior is None else prior & predicate
    return df.withColumn(name, F.coalesce(picked, F.lit(False)))


def positions(df: DataFrame, predicate: Column, index: str = "record_index") -> DataFrame:
    """The positions selected."""
    return df.where(predicate).select(F.col(index).alias("record_index"))


def count(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: how many are selected."""
    return df.agg(F.count_if(predicate).alias("n"))


def bitmaps(df: DataFrame, predicate: Column, index: str = "record_index") -> DataFrame:
    """(bucket, bitmap): position i is bit i % SPAN of bucket i div SPAN + 1. Buckets without a position are left out."""
    at = F.col(index) + 1  # the functions count from 1
    return df.where(predicate).groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def bitmap_or(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_and(*parts: DataFrame) -> DataFrame:
    """A bucket that one of the parts lacks is empty there."""
    both = reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("n"))
    return both.where(F.col("n") == len(parts)).select("bucket", "bitmap")


def has_bit(bitmap: Column, at: Column) -> Column:
    """Whether bit `at` (0 to SPAN - 1) of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def consume(df: DataFrame, part: DataFrame, index: str = "record_index") -> DataFrame:
    """The rows whose positions are set: the bitmaps' rows, one for each SPAN positions, are joined by their bucket and the bit is tested."""
    rows = df.join(part.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")), F.bitmap_bucket_number(F.col(index) + 1) == F.col("_bucket"))
    return rows.where(has_bit(F.col("_bitmap"), F.bitmap_bit_position(F.col(index) + 1))).drop("_bucket", "_bitmap")


def bitmap_not(part: DataFrame, universe: DataFrame, index: str = "record_index") -> DataFrame:
    """The positions of universe that part lacks, by bucket as in consume."""
    rows = universe.select(index).join(part.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")), F.bitmap_bucket_number(F.col(index) + 1) == F.col("_bucket"), "left")
    return bitmaps(rows, F.col("_bitmap").isNull() | ~has_bit(F.col("_bitmap"), F.bitmap_bit_position(F.col(index) + 1)), index)


def bitmap_count(part: DataFrame) -> DataFrame:
    """One row: how many positions are set."""
    return part.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


def unpack(part: DataFrame) -> DataFrame:
    """position of each bit that is set, by words of 64 positions; the first byte of a word holds its first eight."""
    rows = part.select("bucket", F.hex("bitmap").alias("hex"))
    word = lambda k: F.conv(F.substring(F.col("hex"), k * 16 + 1, F.lit(16)), 16, -10).cast("long")
    listed = F.transform(F.sequence(F.lit(0), F.lit(SPAN // 64 - 1)), lambda k: F.struct(k.alias("k"), word(k).alias("word")))
    rows = rows.select("bucket", F.explode(F.filter(listed, lambda x: x["word"] != 0)).alias("x"))
    rows = rows.select("bucket", "x", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("x.word", b) == 1)).alias("b"))
    at = (7 - F.shiftright("b", 3)) * 8 + F.col("b").bitwiseAND(F.lit(7))
    return rows.select(((F.col("bucket") - 1) * SPAN + F.col("x.k") * 64 + at).cast("long").alias("position"))


def shown(part: DataFrame) -> DataFrame:
    """Bitmaps as results: each with its bits set, n, and as hexadecimal digits, two for each byte."""
    return part.withColumn("n", F.bitmap_count("bitmap")).withColumn("bitmap", F.hex("bitmap"))


def shown_sql(positions: str, by: str = "") -> str:
    """SQL for the same, of a query that gives record_index (and one more column, by)."""
    keep, on = (f"{by}, ", f"{by}, ") if by else ("", "")
    return (
        f"select {keep}bucket, sum(bit_count(coalesce(x, 0)))::bigint as n, string_agg(printf('%02X', coalesce(x, 0)), '' order by j) as bitmap "
        f"from (select distinct {keep}record_index // {SPAN} + 1 as bucket from ({positions})) cross join range({SPAN // 8}) as r(j) "
        f"left join (select {keep}record_index // {SPAN} + 1 as bucket, record_index % {SPAN} // 8 as j, sum(1 << (record_index % 8))::int as x from ({positions}) group by all) using ({on}bucket, j) group by {keep}bucket"
    )
