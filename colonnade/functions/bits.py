"""Bit planes of an integer column, and comparisons done bit by bit on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.predicates import check_value


def bits_of(column: Column, width: int) -> list[Column]:
    """The column's bits as booleans, most significant first."""
    return [F.shiftrightunsigned(column.cast("long"), b).bitwiseAND(F.lit(1)) == 1 for b in range(8 * width - 1, -1, -1)]


def serial_compare(column: Column, op: str, value: int, width: int) -> Column:
    """column op value, from the top bit down: equal so far, and already less or greater."""
    check_value(value, width)
    equal, less, greater = F.lit(True), F.lit(False), F.lit(False)
    for k, bit in enumerate(bits_of(column, width)):
        if value >> (8 * width - 1 - k) & 1:
            less, equal = less | (equal & ~bit), equal & bit
        else:
            greater, equal = greater | (equal & bit), equal & ~bit
    return {"eq": equal, "ne": ~equal, "lt": less, "gt": greater, "le": less | equal, "ge": greater | equal}[op]


def planes(df: DataFrame, column: str, width: int, index: str = "record_index") -> DataFrame:
    """Vertical layout: (plane, bucket, bitmap) with plane 0 the most significant bit; planes without a set bit are left out."""
    rows = df.select(F.col(index).alias("i"), F.posexplode(F.array(*bits_of(F.col(column), width))).alias("plane", "bit")).where("bit")
    return rows.groupBy("plane", F.bitmap_bucket_number(F.col("i") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("i") + 1)).alias("bitmap"))


def from_bits(bits: list[Column]) -> Column:
    """The number whose bits, most significant first, these booleans are."""
    return reduce(lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")), bits, F.lit(0).cast("long"))


def transpose8(columns: list[Column]) -> list[Column]:
    """Eight 64-bit words as an 8 x 8 matrix of bytes, transposed: byte k of each word, in order, makes word k."""
    return [from_bytes([F.shiftrightunsigned(c.cast("long"), 8 * (7 - k)).bitwiseAND(F.lit(255)) for c in columns]) for k in range(8)]


def from_bytes(parts: list[Column]) -> Column:
    return reduce(lambda acc, b: F.shiftleft(acc, 8).bitwiseOR(b), parts, F.lit(0).cast("long"))
