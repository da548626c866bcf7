"""Unsigned integer arithmetic on BIGINT columns that wraps at a width of up to 48 bits.

Every function takes a width in bytes; an optional mask (a boolean column) leaves the first argument as it is where the mask is false.
Nothing overflows under ANSI rules: products are built from 12-bit digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.functions.predicates import compare

HASH_FACTOR, HASH_OFFSET = 3634946921, 2096170329  # fixed values of the bucket hash


def _ones(width: int) -> int:
    if not 1 <= width <= 6:
        raise ValueError("widths are 1 to 6 bytes; wider values are DECIMAL(20,0) and are compared and summed only")
    return (1 << (8 * width)) - 1


def wrap(x: Column, width: int) -> Column:
    """x modulo 2^(8 width)."""
    return x.bitwiseAND(F.lit(_ones(width)))


def masked(result: Column, a: Column, mask: Column | None) -> Column:
    return result if mask is None else F.when(mask, result).otherwise(a)


def _two(f):
    def op(a: Column, b, width: int, mask: Column | None = None) -> Column:
        b = b if isinstance(b, Column) else F.lit(b)
        return masked(wrap(f(a.cast("long"), b.cast("long"), width), width), a, mask)

    return op


def _product(a: Column, b: Column, width: int) -> Column:
    total = F.lit(0).cast("long")
    for s in range(0, 8 * width, 12):
        digit = F.shiftrightunsigned(b, s).bitwiseAND(F.lit(4095))
        part = (a * digit).bitwiseAND(F.lit((1 << (8 * width - s)) - 1))
        total = total + F.shiftleft(part, s)
    return total


bit_and = _two(lambda a, b, w: a.bitwiseAND(b))
bit_or = _two(lambda a, b, w: a.bitwiseOR(b))
bit_xor = _two(lambda a, b, w: a.bitwiseXOR(b))
bit_nand = _two(lambda a, b, w: F.bitwise_not(a.bitwiseAND(b)))
bit_nor = _two(lambda a, b, w: F.bitwise_not(a.bitwiseOR(b)))
bit_xnor = _two(lambda a, b, w: F.bitwise_not(a.bitwiseXOR(b)))
add = _two(lambda a, b, w: a + b)
sub = _two(lambda a, b, w: a - b)
mul = _two(_product)


def bit_not(a: Column, width: int, mask: Column | None = None) -> Column:
    return masked(wrap(F.bitwise_not(a.cast("long")), width), a, mask)


def increment(a: Column, width: int, mask: Column | None = None) -> Column:
    return add(a, 1, width, mask)


def shift_left(a: Column, bits: int, width: int, mask: Column | None = None) -> Column:
    if bits >= 8 * width:
        return masked(F.lit(0).cast("long"), a, mask)
    kept = a.cast("long").bitwiseAND(F.lit((1 << (8 * width - bits)) - 1))
    return masked(F.shiftleft(kept, bits), a, mask)


def shift_right(a: Column, bits: int, width: int, mask: Column | None = None) -> Column:
    if bits >= 8 * width:
        return masked(F.lit(0).cast("long"), a, mask)
    return masked(F.shiftrightunsigned(wrap(a.cast("long"), width), bits), a, mask)


def is_zero(a: Column, width: int, mask: Column | None = None) -> Column:
    """Whether a is zero; with a mask, 1 or 0, and a itself where the mask is false."""
    found = wrap(a.cast("long"), width) == 0
    return found if mask is None else masked(found.cast("long"), a, mask)


def all_ones(a: Column, width: int, mask: Column | None = None) -> Column:
    """Whether every bit of a is set; with a mask as in is_zero."""
    found = wrap(a.cast("long"), width) == F.lit(_ones(width))
    return found if mask is None else masked(found.cast("long"), a, mask)


def compare_value(a: Column, op: str, value: int, width: int, mask: Column | None = None) -> Column:
    """1 where a op value holds, else 0; a itself where the mask is false."""
    return masked(compare(a, op, value, width).cast("long"), a, mask)


def majority(a: Column, b: Column, c: Column, mask: Column | None = None) -> Column:
    """Each bit as most of the three have it."""
    return masked(a.bitwiseAND(b).bitwiseOR(b.bitwiseAND(c)).bitwiseOR(c.bitwiseAND(a)), a, mask)


def popcount(a: Column, mask: Column | None = None) -> Column:
    found = F.bit_count(a.cast("long"))
    return found if mask is None else masked(found.cast("long"), a, mask)


def bucket(key: Column, initial_buckets: int, mask: Column | None = None) -> Column:
    """Bucket of a key in a table with a power of two buckets: the low bits of factor * key + offset."""
    m = initial_buckets - 1
    if initial_buckets < 1 or initial_buckets & m or initial_buckets > 1 << 30:
        raise ValueError("the number of buckets is a power of two, 2^30 at most")
    return masked((key.cast("long").bitwiseAND(F.lit(m)) * F.lit(HASH_FACTOR) + F.lit(HASH_OFFSET)).bitwiseAND(F.lit(m)), key, mask)
