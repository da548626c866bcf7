"""Comparisons of an unsigned column with a value, as Columns that Catalyst can push to the scan."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "gt": operator.gt, "le": operator.le, "ge": operator.ge}


def check_value(value: int, width: int | None) -> int:
    """The value, if it fits an unsigned integer of width bytes."""
    if width is not None and not 0 <= value < 1 << (8 * width):
        raise ValueError(f"{value} does not fit an unsigned integer of {width} bytes")
    return value


def compare(column: Column, op: str, value: int, width: int | None = None) -> Column:
    """column op value, for op of eq, ne, lt, gt, le, ge."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}; known are {', '.join(COMPARISONS)}")
    return COMPARISONS[op](column, F.lit(check_value(value, width)))


def between(column: Column, low: int, high: int, inclusive: str = "both", width: int | None = None) -> Column:
    """low to high with both ends (inclusive="both") or neither (inclusive="neither")."""
    low, high = F.lit(check_value(low, width)), F.lit(check_value(high, width))
    if inclusive == "both":
        return column.between(low, high)
    if inclusive == "neither":
        return (column > low) & (column < high)
    raise ValueError("inclusive is 'both' or 'neither'")


def inverse(predicate: Column, prior: Column | None = None, negate_conjunction: bool = False) -> Column:
    """What predicate leaves out. With a prior selection: prior and not predicate, or, if negate_conjunction, not (prior and predicate)."""
    if prior is None:
        return ~predicate
    return ~(prior & predicate) if negate_conjunction else prior & ~predicate


def subfield(column: Column, total_bytes: int, offset_bytes: int, size_bytes: int) -> Column:
    """The unsigned integer in bytes [offset, offset + size) of a big-endian composite key of total_bytes (8 at most)."""
    if not (0 <= offset_bytes and 0 < size_bytes and offset_bytes + size_bytes <= total_bytes <= 8):
        raise ValueError("the sub-field lies outside the key")
    value = F.shiftrightunsigned(column.cast("long"), 8 * (total_bytes - offset_bytes - size_bytes))
    return value if size_bytes == 8 else value.bitwiseAND(F.lit((1 << (8 * size_bytes)) - 1))
