"""The thirteen star-schema queries, as selections (the lines found, with the columns a query emits) and in full (summed, grouped, ordered).

A query is a row of QUERIES: predicates on the fact table, and for each dimension its predicate and the columns it hands on. A
dimension that hands on nothing is a semi join. The order in which dimensions are joined is a parameter; results are the same.

Lineorder is lineitem and orders here. Each dimension is joined to the one of the two that has its key, so that both are cut
down before they meet; of equal dimensions' order, that of the parameter is kept on each side. A query also names what its predicates
imply in the files' own units and columns, which Parquet can skip row groups by.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.operators.joins import build_side
from colonnade.sources import views
from colonnade.sources.readers import parquet

#: Dimension: view, key, key in the fact table, the table it keeps no more rows of.
DIMENSIONS = {
    "date": (views.dates, "d_datekey", "lo_orderdate", None),
    "supplier": (views.suppliers, "s_suppkey", "lo_suppkey", "supplier"),
    "customer": (views.customers, "c_custkey", "lo_custkey", "customer"),
    "part": (views.parts, "p_partkey", "lo_partkey", "part"),
}
SQL_NAMES = {"date": "dwdate", "supplier": "s", "customer": "c", "part": "p"}


@dataclass(frozen=True)
class Query:
    dimensions: dict[str, tuple[str, tuple[str, ...]]]  # in join order: predicate, columns handed on
    measures: tuple[str, ...]
    total: str
    groups: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    fact: str = "true"
    flight: int = 0
    scan: str = "true"  # what fact implies on lineitem, as it is stored
    days: tuple[str, str] | None = None  # the first day that the date's predicate lets through, and the first after

    def supply_cost(self) -> bool:
        return "lo_supplycost" in self.measures


def _q1(date: str, days: tuple[str, str], discount: tuple[int, int], quantity: tuple[int, int]) -> Query:
    """discount and quantity: least and greatest."""
    fact = f"lo_discount between {discount[0]} and {discount[1]} and lo_quantity between {quantity[0]} and {quantity[1]}"
    # half a unit more on either side than rounding can move a value
    scan = f"l_discount >= {discount[0] - 1}e-2D and l_discount <= {discount[1] + 1}e-2D and l_quantity >= {quantity[0]}D and l_quantity < {quantity[1] + 1}D"
    return Query({"date": (date, ())}, ("lo_extendedprice", "lo_discount"), "lo_extendedprice * lo_discount", fact=fact, flight=1, scan=scan, days=days)


def _q2(part: str, region: str) -> Query:
    dims = {"part": (part, ("p_brand1",)), "supplier": (f"s_region = '{region}'", ()), "date": ("true", ("d_year",))}
    return Query(dims, ("lo_revenue",), "lo_revenue", ("d_year", "p_brand1"), ("d_year", "p_brand1"), flight=2)


def _q3(c: str, s: str, level: str, date: str, days: tuple[str, str]) -> Query:
    dims = {"supplier": (s, (f"s_{level}",)), "customer": (c, (f"c_{level}",)), "date": (date, ("d_year",))}
    return Query(dims, ("lo_revenue",), "lo_revenue", (f"c_{level}", f"s_{level}", "d_year"), ("d_year", "-total"), flight=3, days=days)


def _q4(c: tuple, s: tuple, p: tuple, date: str, groups: tuple, days: tuple[str, str] | None = None) -> Query:
    dims = {"supplier": s, "customer": c, "part": p, "date": (date, ("d_year",))}
    return Query(dims, ("lo_revenue", "lo_supplycost"), "lo_revenue - lo_supplycost", groups, groups, flight=4, days=days)


_CITIES = "('NATION_3-0', 'NATION_3-1', 'NATION_8-0', 'NATION_8-1')"
_SIX_YEARS = "d_year between 1995 and 2000", ("1995-01-01", "2001-01-01")
QUERIES = {
    "q1_1": _q1("d_year = 1995", ("1995-01-01", "1996-01-01"), (1, 3), (0, 24)),
    "q1_2": _q1("d_yearmonthnum = 199601", ("1996-01-01", "1996-02-01"), (4, 6), (26, 35)),
    "q1_3": _q1("d_weeknuminyear = 6 and d_year = 1996", ("1996-02-05", "1996-02-12"), (5, 7), (26, 35)),
    "q2_1": _q2("p_category = 'MFGR#12'", "AMERICA"),
    "q2_2": _q2("p_brand1 between 'MFGR#2221' and 'MFGR#2228'", "ASIA"),
    "q2_3": _q2("p_brand1 = 'MFGR#2221'", "EUROPE"),
    "q3_1": _q3("c_region = 'ASIA'", "s_region = 'ASIA'", "nation", *_SIX_YEARS),
    "q3_2": _q3("c_nation = 'NATION_1'", "s_nation = 'NATION_1'", "city", *_SIX_YEARS),
    "q3_3": _q3(f"c_city in {_CITIES}", f"s_city in {_CITIES}", "city", *_SIX_YEARS),
    "q3_4": _q3(f"c_city in {_CITIES}", f"s_city in {_CITIES}", "city", "d_yearmonth = 'Dec1999'", ("1999-12-01", "2000-01-01")),
    "q4_1": _q4(("c_region = 'AMERICA'", ("c_nation",)), ("s_region = 'AMERICA'", ()), ("p_mfgr in ('MFGR#1', 'MFGR#2')", ()), "true", ("d_year", "c_nation")),
    "q4_2": _q4(("c_region = 'AMERICA'", ()), ("s_region = 'AMERICA'", ("s_nation",)), ("p_mfgr in ('MFGR#1', 'MFGR#2')", ("p_category",)), "d_year in (1999, 2000)", ("d_year", "s_nation", "p_category"), ("1999-01-01", "2001-01-01")),
    "q4_3": _q4(("c_region = 'AMERICA'", ()), ("s_nation = 'NATION_1'", ("s_city",)), ("p_category = 'MFGR#14'", ("p_brand1",)), "d_year in (1999, 2000)", ("d_year", "s_city", "p_brand1"), ("1999-01-01", "2001-01-01")),
}


def orders(q: Query) -> list[tuple[str, ...]]:
    """The join orders: dates last, all others in every order."""
    rest = [d for d in q.dimensions if d != "date"]
    return [(*o, "date") for o in permutations(rest)]


def selection(spark: SparkSession, sf_dir: str, name: str, order: tuple[str, ...] | None = None) -> DataFrame:
    """The lines found: their keys, the measures and what the dimensions hand on."""
    q = QUERIES[name]
    days = "true" if q.days is None else f"o_orderdate >= timestamp_ntz'{q.days[0]}' and o_orderdate < timestamp_ntz'{q.days[1]}'"
    sides = {"lines": views.lines(spark, sf_dir, q.scan).where(q.fact), "orders": views.placed_orders(spark, sf_dir, days)}
    out = ["lo_orderkey", "lo_linenumber", *(m for m in q.measures if m != "lo_supplycost")]
    for d in order or q.dimensions:
        view, key, foreign, base = DIMENSIONS[d]
        predicate, columns = q.dimensions[d]
        columns += ("lo_supplycost",) if d == "part" and q.supply_cost() else ()  # the part's own price: one join hands on both
        build = view(spark, sf_dir).where(predicate).select(key, *columns)
        # the calendar's days are counted; other dimensions are measured
        build = F.broadcast(build) if d == "date" else build_side(build, parquet(spark, sf_dir, base))
        side = "orders" if d in ("date", "customer") else "lines"
        sides[side] = sides[side].join(build, F.col(foreign) == F.col(key), "inner" if columns else "left_semi")
        out += columns
    rows = sides["lines"].join(sides["orders"], F.col("lo_orderkey") == F.col("o_orderkey"))
    return rows.select(*sorted(out))


def full(spark: SparkSession, sf_dir: str, name: str, order: tuple[str, ...] | None = None) -> DataFrame:
    """The query as published: the sum, by its groups and in its order."""
    q = QUERIES[name]
    total = F.sum(F.expr(q.total)).alias("total")
    rows = selection(spark, sf_dir, name, order)
    if not q.groups:
        return rows.agg(total)
    by = [F.col(o[1:]).desc() if o[0] == "-" else F.col(o) for o in q.order]
    return rows.groupBy(*q.groups).agg(total).orderBy(*by)


def _from_sql(q: Query) -> str:
    where = [q.fact, *(p for p, _ in q.dimensions.values())]
    joins = " ".join(f"join {SQL_NAMES[d]} on {DIMENSIONS[d][2]} = {DIMENSIONS[d][1]}" for d in q.dimensions)
    return f"from lineorder {joins} where {' and '.join(where)}"


def selection_sql(name: str) -> str:
    q = QUERIES[name]
    columns = sorted(["lo_orderkey", "lo_linenumber", *q.measures, *(c for _, cs in q.dimensions.values() for c in cs)])
    return f"with {views.SSB_SQL} select {', '.join(columns)} {_from_sql(q)}"


def full_sql(name: str) -> str:
    q = QUERIES[name]
    groups = ", ".join(q.groups)
    by = ", ".join(f"{o[1:]} desc" if o[0] == "-" else o for o in q.order)
    tail = f"group by {groups} order by {by}" if groups else ""
    return f"with {views.SSB_SQL} select {groups + ', ' if groups else ''}sum({q.total})::bigint as total {_from_sql(q)} {tail}"
