"""The suites' tables as views of the TPC-H-like ones, in Spark and as SQL with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.sources.readers import parquet


def sqb_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return parquet(spark, sf_dir, "orders").select(k.alias("record_index"), k.alias("a_k"), F.col("o_custkey").alias("a_b_k"), (k * 7 % 10).alias("a_10"), ((k * 37 + 11) % 100).alias("a_100"))


def sqb_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return parquet(spark, sf_dir, "customer").select(k.alias("record_index"), k.alias("b_k"), (k * 3 % 10).alias("b_10"), ((k * 53 + 7) % 100).alias("b_100"))


SQB_SQL = """
a as (select o_orderkey as record_index, o_orderkey as a_k, o_custkey as a_b_k, o_orderkey * 7 % 10 as a_10, (o_orderkey * 37 + 11) % 100 as a_100 from orders),
b as (select c_custkey as record_index, c_custkey as b_k, c_custkey * 3 % 10 as b_10, (c_custkey * 53 + 7) % 100 as b_100 from customer)
"""


def lines(spark: SparkSession, sf_dir: str, scan: str = "true") -> DataFrame:
    """The columns of lineorder that lineitem holds; money in hundredths, revenue in ten-thousandths, all whole numbers.

    scan: a predicate in the file's own units and columns, which reaches the Parquet scan.
    """
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return parquet(spark, sf_dir, "lineitem").where(scan).select(
        F.col("l_orderkey").alias("lo_orderkey"),
        F.col("l_linenumber").cast("long").alias("lo_linenumber"),
        F.col("l_partkey").alias("lo_partkey"),
        F.col("l_suppkey").alias("lo_suppkey"),
        F.col("l_quantity").cast("long").alias("lo_quantity"),
        cents("l_discount").alias("lo_discount"),
        cents("l_extendedprice").alias("lo_extendedprice"),
        (cents("l_extendedprice") * (100 - cents("l_discount"))).alias("lo_revenue"),
    )


def placed_orders(spark: SparkSession, sf_dir: str, scan: str = "true") -> DataFrame:
    """The columns of lineorder that orders holds; scan as in lines."""
    day = F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")
    return parquet(spark, sf_dir, "orders").where(scan).select("o_orderkey", F.col("o_custkey").alias("lo_custkey"), day.cast("long").alias("lo_orderdate"))


#: First and last day of the calendar: bounds its size whatever the tables.
CALENDAR = ("1900-01-01", "2099-12-31")


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each day of the calendar (73,049 of them), made without reading a table."""
    first, last = (F.to_date(F.lit(x)) for x in CALENDAR)
    d = spark.range(73049).select(F.date_add(first, F.col("id").cast("int")).alias("d")).where(F.col("d") <= last)
    year, month = F.year("d"), F.month("d")
    return d.select(
        (year * 10000 + month * 100 + F.dayofmonth("d")).cast("long").alias("d_datekey"),
        year.cast("long").alias("d_year"),
        (year * 100 + month).cast("long").alias("d_yearmonthnum"),
        F.date_format("d", "MMMyyyy").alias("d_yearmonth"),
        (F.floor((F.dayofyear("d") - 1) / 7) + 1).cast("long").alias("d_weeknuminyear"),
    )


def _places(spark: SparkSession, sf_dir: str, table: str, p: str, key: str) -> DataFrame:
    nations = parquet(spark, sf_dir, "nation").join(parquet(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = parquet(spark, sf_dir, table).join(nations, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
    city = F.concat("n_name", F.lit("-"), (F.col(key) % 2).cast("string"))
    return rows.select(key, F.col("n_name").alias(f"{p}_nation"), F.col("r_name").alias(f"{p}_region"), city.alias(f"{p}_city"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir, "supplier", "s", "s_suppkey")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir, "customer", "c", "c_custkey")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.substring_index("p_brand", "#", -1).cast("int") - 1
    mfgr = F.concat(F.lit("MFGR#"), (F.floor(b / 5) + 1).cast("string"))
    category = F.concat(mfgr, (b % 5 + 1).cast("string"))
    brand = F.concat(category, (F.col("p_partkey") % 40 + 1).cast("string"))
    cost = F.round(F.col("p_retailprice") * 6000).cast("long")
    return parquet(spark, sf_dir, "part").select("p_partkey", mfgr.alias("p_mfgr"), category.alias("p_category"), brand.alias("p_brand1"), cost.alias("lo_supplycost"))


SSB_SQL = """
lineorder as (select l_orderkey as lo_orderkey, l_linenumber::bigint as lo_linenumber, o_custkey as lo_custkey, l_partkey as lo_partkey, l_suppkey as lo_suppkey,
    (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::bigint as lo_orderdate, l_quantity::bigint as lo_quantity,
    round(l_discount * 100)::bigint as lo_discount, round(l_extendedprice * 100)::bigint as lo_extendedprice,
    round(l_extendedprice * 100)::bigint * (100 - round(l_discount * 100)::bigint) as lo_revenue, round(p_retailprice * 6000)::bigint as lo_supplycost
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
dwdate as (select distinct (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::bigint as d_datekey, year(o_orderdate)::bigint as d_year,
    (year(o_orderdate) * 100 + month(o_orderdate))::bigint as d_yearmonthnum, strftime(o_orderdate, '%b%Y') as d_yearmonth,
    ((dayofyear(o_orderdate) - 1) // 7 + 1)::bigint as d_weeknuminyear from orders),
places as (select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey),
s as (select s_suppkey, n_name as s_nation, r_name as s_region, n_name || '-' || (s_suppkey % 2) as s_city from supplier join places on s_nationkey = n_nationkey),
c as (select c_custkey, n_name as c_nation, r_name as c_region, n_name || '-' || (c_custkey % 2) as c_city from customer join places on c_nationkey = n_nationkey),
b as (select p_partkey, substr(p_brand, 7)::int - 1 as k from part),
p as (select p_partkey, 'MFGR#' || (k // 5 + 1) as p_mfgr, 'MFGR#' || (k // 5 + 1) || (k % 5 + 1) as p_category,
    'MFGR#' || (k // 5 + 1) || (k % 5 + 1) || (p_partkey % 40 + 1) as p_brand1 from b)
"""
