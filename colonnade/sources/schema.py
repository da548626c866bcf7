"""Explicit schemas, unsigned widths and the dictionary domains of the star schema."""

from __future__ import annotations

from pyspark.sql import types as T

#: Spark type that holds every unsigned value of so many bytes.
UNSIGNED = {1: T.ShortType(), 2: T.IntegerType(), 3: T.IntegerType(), 4: T.LongType(), 6: T.LongType(), 8: T.DecimalType(20, 0)}


def _struct(spec: str) -> T.StructType:
    kinds = {"i": T.IntegerType(), "l": T.LongType(), "s": T.StringType(), "b": T.BooleanType(), "d": T.DoubleType(), "t": T.TimestampNTZType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in spec.split())])


#: Columns in file order.
SSB = {
    "date": _struct(
        "date_key:i date:s day_of_week:s month:s year:i year_month_num:i year_month:s day_num_in_week:i day_num_in_month:i day_num_in_year:i month_num_in_year:i "
        "week_num_in_year:i selling_season:s last_day_in_week_flag:b last_day_in_month_flag:b holiday_flag:b weekday_flag:b"
    ),
    "supplier": _struct("supplier_key:i name:s address:s city:s nation:s region:s phone:s"),
    "part": _struct("part_key:i name:s mfgr:s category:s brand:s color:s type:s size:i container:s"),
    "customer": _struct("customer_key:i name:s address:s city:s nation:s region:s phone:s mktsegment:s"),
    "lineorder": _struct(
        "order_key:i line_number:i customer_key:i part_key:i supplier_key:i order_date_key:i order_priority:s ship_priority:s quantity:i extended_price:l "
        "order_total_price:l discount:i revenue:l supply_cost:l tax:i commit_date_key:i ship_mode:s"
    ),
}

SQB = {"a": _struct("a_k:l a_b_k:l a_10:i a_100:i"), "b": _struct("b_k:l b_10:i b_100:i")}

#: The TPC-H-like tables that the suites' views are made from.
TABLES = {
    "region": _struct("r_regionkey:i r_name:s"),
    "nation": _struct("n_nationkey:i n_name:s n_regionkey:i"),
    "customer": _struct("c_custkey:l c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s"),
    "supplier": _struct("s_suppkey:l s_name:s s_nationkey:i s_acctbal:d"),
    "part": _struct("p_partkey:l p_name:s p_brand:s p_type:s p_size:i p_retailprice:d"),
    "orders": _struct("o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s"),
    "lineitem": _struct("l_orderkey:l l_partkey:l l_suppkey:l l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t"),
    "events": _struct("event_id:l ts:t user_id:l event_type:s value:d props:s"),
}

# The names of the star schema's regions and nations, in the order of their codes.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATIONS = [
    "ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "EGYPT", "ETHIOPIA", "FRANCE", "GERMANY", "INDIA", "INDONESIA", "IRAN", "IRAQ", "JAPAN",
    "JORDAN", "KENYA", "MOROCCO", "MOZAMBIQUE", "PERU", "CHINA", "ROMANIA", "SAUDI ARABIA", "VIETNAM", "RUSSIA", "UNITED KINGDOM", "UNITED STATES",
]


def cities() -> list[str]:
    """Ten to a nation: the name cut or padded to nine characters, and a digit."""
    return [f"{n[:9]:9}{d}" for n in NATIONS for d in range(10)]


def manufacturers() -> list[str]:
    return [f"MFGR#{m}" for m in range(1, 6)]


def categories() -> list[str]:
    return [f"{m}{c}" for m in manufacturers() for c in range(1, 6)]


def brands() -> list[str]:
    return [f"{c}{b}" for c in categories() for b in range(1, 41)]
