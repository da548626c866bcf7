"""All queries over the star-schema tables, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colonnade.plans import kernels, sqb, ssb


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = kernels.queries() | sqb.queries()
    for name, q in ssb.QUERIES.items():
        out[f"ssb_{name}"] = lambda s, d, n=name: ssb.full(s, d, n)
        out[f"ssb_{name}_selection"] = lambda s, d, n=name: ssb.selection(s, d, n)
        for order in ssb.orders(q):
            if order != tuple(q.dimensions):
                out[f"ssb_{name}_by_{'_'.join(order[:-1])}"] = lambda s, d, n=name, o=order: ssb.full(s, d, n, o)
    return out


def oracle_sql() -> dict[str, str]:
    out = kernels.oracle_sql() | sqb.oracle_sql()
    for name, q in ssb.QUERIES.items():
        out[f"ssb_{name}"] = ssb.full_sql(name)
        out[f"ssb_{name}_selection"] = ssb.selection_sql(name)
        for order in ssb.orders(q):
            if order != tuple(q.dimensions):
                out[f"ssb_{name}_by_{'_'.join(order[:-1])}"] = ssb.full_sql(name)
    return out
