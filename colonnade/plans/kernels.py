"""Each operator on its own, over the shared tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions import bits, integers
from colonnade.functions.predicates import between, compare, inverse, subfield
from colonnade.operators import aggregates, emit, hashstats, joins, selection
from colonnade.sources import generators, views
from colonnade.sources.readers import decode, encode, parquet

#: The filter studies' value and range, for years.
YEAR, LOW, HIGH = 1997, 1996, 1999

KEYS_SQL = "keys as (select o_orderkey as record_index, year(o_orderdate)::bigint as pi, o_custkey as fk, (o_orderkey * 37 + 11) % 100 as v from orders)"
BUILD_SQL = "build as (select c_custkey as key, c_custkey * 3 % 10 as payload from customer where (c_custkey * 53 + 7) % 100 < 25)"


def keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return parquet(spark, d, "orders").select(k.alias("record_index"), F.year("o_orderdate").cast("long").alias("pi"), F.col("o_custkey").alias("fk"), ((k * 37 + 11) % 100).alias("v"))


def build(spark: SparkSession, d: str) -> DataFrame:
    b = views.sqb_b(spark, d).where("b_100 < 25").select(F.col("b_k").alias("key"), F.col("b_10").alias("payload"))
    return joins.build_side(b, parquet(spark, d, "customer"))




def _entries() -> dict:
    """name: (query, SQL after the with clause)."""
    out: dict = {}
    k = lambda f: lambda s, d: f(keys(s, d))
    # columns are made when a query runs: the names can be read without a session
    pi, v = (lambda: F.col("pi")), (lambda: F.col("v"))
    prior = lambda: v() < 40
    operators = {"eq": "=", "ne": "<>", "lt": "<", "gt": ">", "le": "<=", "ge": ">="}
    for op, sign in operators.items():
        p = lambda op=op: compare(pi(), op, YEAR, 2)
        out[f"filter_{op}"] = (k(lambda t, p=p: selection.select(t, p(), prior()).select("record_index", "pi")), f"select record_index, pi from keys where v < 40 and pi {sign} {YEAR}")
        out[f"filter_{op}_index"] = (k(lambda t, p=p: selection.positions(t, p())), f"select record_index from keys where pi {sign} {YEAR}")
        out[f"filter_{op}_bit_serial"] = (k(lambda t, op=op: selection.positions(t, bits.serial_compare(pi(), op, YEAR, 2))), f"select record_index from keys where pi {sign} {YEAR}")
        if op not in ("eq", "ne"):
            out[f"filter_inverse_{op}"] = (k(lambda t, p=p: selection.flags(t, inverse(p(), prior())).select("record_index", "sel")), f"select record_index, v < 40 and not pi {sign} {YEAR} as sel from keys")
        out[f"filter_negated_{op}"] = (k(lambda t, p=p: selection.flags(t, inverse(p(), prior(), True)).select("record_index", "sel")), f"select record_index, not (v < 40 and pi {sign} {YEAR}) as sel from keys")
    closed, opened = (lambda: between(pi(), LOW, HIGH, width=2)), (lambda: between(pi(), LOW, HIGH, "neither", 2))
    out["filter_between"] = (k(lambda t: selection.select(t, closed(), prior()).select("record_index", "pi")), f"select record_index, pi from keys where v < 40 and pi between {LOW} and {HIGH}")
    out["filter_between_open"] = (k(lambda t: selection.select(t, opened(), prior()).select("record_index", "pi")), f"select record_index, pi from keys where v < 40 and pi > {LOW} and pi < {HIGH}")
    out["filter_inverse_between"] = (k(lambda t: selection.select(t, inverse(closed(), prior())).select("record_index", "pi")), f"select record_index, pi from keys where v < 40 and not pi between {LOW} and {HIGH}")
    composite = lambda: F.shiftleft(pi(), 8).bitwiseOR(v())
    piece = lambda: subfield(F.col("c"), 3, 2, 1)
    for op, sign in operators.items():
        out[f"filter_subfield_{op}"] = (k(lambda t, op=op: selection.select(t.withColumn("c", composite()), compare(piece(), op, 25, 1)).select("record_index", "c")), f"select record_index, pi * 256 + v as c from keys where v {sign} 25")
    out["filter_subfield_between"] = (k(lambda t: selection.select(t.withColumn("c", composite()), between(piece(), 25, 60, width=1)).select("record_index", "c")), "select record_index, pi * 256 + v as c from keys where v between 25 and 60")
    out["filter_subfield_high"] = (k(lambda t: selection.select(t.withColumn("c", composite()), compare(subfield(F.col("c"), 3, 0, 2), "eq", YEAR, 2)).select("record_index", "c")), f"select record_index, pi * 256 + v as c from keys where pi = {YEAR}")
    out["filter_subfield"] = (k(lambda t: selection.select(t.withColumn("c", composite()), subfield(F.col("c"), 3, 2, 1) < 25).select("record_index", "c")), "select record_index, pi * 256 + v as c from keys where v < 25")
    out["logical_and"] = (k(lambda t: selection.positions(t, compare(pi(), "ge", LOW) & compare(v(), "lt", 25))), f"select record_index from keys where pi >= {LOW} and v < 25")
    out["logical_or"] = (k(lambda t: selection.positions(t, compare(pi(), "eq", LOW) | compare(v(), "lt", 25))), f"select record_index from keys where pi = {LOW} or v < 25")
    out["logical_not"] = (k(lambda t: selection.positions(t, ~(compare(pi(), "eq", LOW) | compare(v(), "lt", 25)))), f"select record_index from keys where not (pi = {LOW} or v < 25)")
    a, b = (lambda: compare(pi(), "ge", LOW)), (lambda: compare(v(), "lt", 25))
    unpacked = lambda m: selection.unpack(m)
    out["bitmap_and"] = (k(lambda t: unpacked(selection.bitmap_and(selection.bitmaps(t, a()), selection.bitmaps(t, b())))), f"select record_index as position from keys where pi >= {LOW} and v < 25")
    out["bitmap_or"] = (k(lambda t: unpacked(selection.bitmap_or(selection.bitmaps(t, a()), selection.bitmaps(t, b())))), f"select record_index as position from keys where pi >= {LOW} or v < 25")
    out["bitmap_not"] = (k(lambda t: unpacked(selection.bitmap_not(selection.bitmaps(t, b()), t))), "select record_index as position from keys where not v < 25")
    out["count_selected"] = (k(lambda t: selection.count(t, b())), "select count(*) as n from keys where v < 25")
    out["bitmap_count"] = (k(lambda t: selection.bitmap_count(selection.bitmaps(t, b()))), "select count(*) as n from keys where v < 25")
    out["consume_bitmap"] = (
        k(lambda t: selection.consume(t, selection.bitmaps(t, b())).agg(F.sum("pi").alias("total"))),
        "select sum(pi)::bigint as total from keys where v < 25",
    )
    out["consume_indices"] = (
        k(lambda t: t.join(selection.positions(t, b()).withColumnRenamed("record_index", "position"), F.col("record_index") == F.col("position"), "left_semi").agg(F.sum("pi").alias("total"))),
        "select sum(pi)::bigint as total from keys where v < 25",
    )

    j = lambda f: lambda s, d: f(keys(s, d), build(s, d))
    hit = "fk in (select key from build)"
    out["semijoin_flags"] = (j(lambda t, u: joins.semi_flags(t, u, "fk", "key").select("record_index", "sel")), f"select record_index, {hit} as sel from keys")
    out["semijoin_flags_masked"] = (j(lambda t, u: joins.semi_flags(t, u, "fk", "key", prior()).select("record_index", "sel")), f"select record_index, v < 40 and {hit} as sel from keys")
    out["join_payload"] = (j(lambda t, u: joins.payload_join(t, u, "fk", "key").select("record_index", "payload")), "select record_index, payload from keys join build on fk = key")
    out["join_payload_masked"] = (j(lambda t, u: joins.payload_join(t, u, "fk", "key", prior()).select("record_index", "payload")), "select record_index, payload from keys join build on fk = key where v < 40")
    out["join_index"] = (j(lambda t, u: joins.index_join(t, u, "fk", "key")), f"select record_index from keys where {hit}")
    out["join_index_masked"] = (j(lambda t, u: joins.index_join(t, u, "fk", "key", prior())), f"select record_index from keys where v < 40 and {hit}")
    out["join_index_payload"] = (j(lambda t, u: joins.index_payload_join(t, u, "fk", "key", "payload")), "select record_index, payload from keys join build on fk = key")
    out["join_index_payload_masked"] = (j(lambda t, u: joins.index_payload_join(t, u, "fk", "key", "payload", prior())), "select record_index, payload from keys join build on fk = key where v < 40")
    out["hash_build"] = (lambda s, d: build(s, d), "select key, payload from build")
    out["hash_lookup"] = (
        lambda s, d: joins.lookup(views.sqb_b(s, d).select("b_k"), joins.unique_build(keys(s, d).where("v < 10"), "fk", "pi"), "b_k", "fk", "pi"),
        "select b_k, payload from (select c_custkey as b_k from customer) left join (select fk, arg_min(pi, record_index) as payload from keys where v < 10 group by fk) on b_k = fk",
    )
    out["hash_build_probe"] = (lambda s, d: joins.semi(keys(s, d), keys(s, d).where("v < 5").select(F.col("fk").alias("key")), "fk", "key").select("record_index"), "select record_index from keys where fk in (select fk from keys where v < 5)")
    hashed = f"({integers.HASH_FACTOR}::hugeint * c_custkey + {integers.HASH_OFFSET}) % 16"
    out["hash_statistics"] = (
        lambda s, d: hashstats.statistics(views.sqb_b(s, d), "b_k", 16),
        f"select sum(n)::bigint as total_records, (sum(ceil(n / 31) - 1) + 16)::bigint as buckets, ((sum(ceil(n / 31) - 1) + 16) * 128)::bigint as bytes, max(ceil(n / 31))::bigint as longest_bucket_chain, max(n)::bigint as longest_record_chain from (select {hashed} as h, count(*) as n from customer group by 1)",
    )
    out["hash_histogram"] = (
        lambda s, d: hashstats.histogram(views.sqb_b(s, d), "b_k", 16),
        f"select ceil(n / 31)::bigint as chain, count(*) as buckets from (select h, count(c_custkey) as n from range(16) as r(h) left join (select {hashed} as hh, c_custkey from customer) on h = hh group by h) group by 1",
    )
    out["hash_traced_lookup"] = (
        lambda s, d: hashstats.traced(keys(s, d).select("record_index", "fk"), "fk", views.sqb_b(s, d).where("b_100 < 25"), "b_k", 16).select("record_index", "hit", "buckets_visited", "compares"),
        f", places as (select c_custkey, {hashed} as h, row_number() over (partition by {hashed} order by c_custkey) as place from customer where (c_custkey * 53 + 7) % 100 < 25), chains as (select h, count(*) as n from places group by h) "
        f"select record_index, place is not null as hit, coalesce(ceil(place / 31), ceil(n / 31), 1)::bigint as buckets_visited, coalesce(place, n, 1) as compares from keys left join places on fk = c_custkey left join chains on ({integers.HASH_FACTOR}::hugeint * fk + {integers.HASH_OFFSET}) % 16 = chains.h",
    )
    initials, capacities = [64, 256, 1024, 4096, 16384], [7, 15, 31, 63]
    swept = f"({integers.HASH_FACTOR}::hugeint * p_partkey + {integers.HASH_OFFSET}) % i"
    out["hash_geometry_sweep"] = (
        lambda s, d: hashstats.sweep(views.parts(s, d).where("p_category = 'MFGR#12'"), "p_partkey", initials, capacities),
        f", sizes as (select i, {swept} as h, count(*) as n from (select p_partkey from part where substr(p_brand, 7)::int = 2), (select unnest({initials}) as i) group by 1, 2) "
        "select i::bigint as initial_buckets, c::bigint as capacity, sum(n)::bigint as total_records, (sum(ceil(n / c) - 1) + i)::bigint as buckets, ((sum(ceil(n / c) - 1) + i) * 128)::bigint as bytes, "
        f"max(ceil(n / c))::bigint as longest_bucket_chain, max(n)::bigint as longest_record_chain from sizes, (select unnest({capacities}) as c) group by i, c",
    )
    out["emit_values"] = (k(lambda t: emit.values(t, b(), "record_index", "pi")), "select record_index, pi from keys where v < 25")
    out["emit_payload"] = (
        lambda s, d: emit.payloads(keys(s, d), F.col("v") < 25, views.sqb_b(s, d).select("b_k", "b_10"), "fk", "b_k", "b_10"),
        "select record_index, c_custkey * 3 % 10 as payload from keys join customer on fk = c_custkey where v < 25",
    )
    out["sum_exact"] = (k(lambda t: aggregates.total(t, "pi")), "select sum(pi)::bigint as total from keys")
    out["sum_wrapped"] = (k(lambda t: aggregates.total(t, "pi", 2)), "select (sum(pi) % 65536)::bigint as total from keys")
    out["group_sum"] = (k(lambda t: aggregates.group_total(t, "v", "pi")), 'select v as "group", sum(pi)::bigint as total from keys group by v')
    out["group_sum_dense"] = (k(lambda t: aggregates.group_total(t.where("v < 25"), "v", "pi", 100)), 'select g as "group", coalesce(sum(pi), 0)::bigint as total from range(100) as r(g) left join (select * from keys where v < 25) on v = g group by g')
    for kind, sql in (("tinyint", "utinyint"), ("smallint", "usmallint"), ("int", "uinteger"), ("bigint", "ubigint")):
        for t in (0, 1, 5, 10, 25, 50, 100):
            out[f"typed_selection_{kind}_{t}"] = (k(lambda x, kind=kind, t=t: selection.positions(x, F.col("v").cast(kind) < F.lit(t).cast(kind))), f"select record_index from keys where v::{sql} < {t}")
            typed = lambda kind=kind, t=t: F.col("v").cast(kind) < F.lit(t).cast(kind)
            out[f"typed_selection_{kind}_{t}_values"] = (k(lambda x, p=typed, kind=kind: emit.values(x.withColumn("value", F.col("v").cast(kind).cast("long")), p(), "record_index", "value")), f"select record_index, v as value from keys where v::{sql} < {t}")
            out[f"typed_selection_{kind}_{t}_bitmap"] = (k(lambda x, p=typed: selection.shown(selection.bitmaps(x, p()))), selection.shown_sql(f"select record_index from keys where v::{sql} < {t}"))
    out["record_equality"] = (k(lambda t: selection.positions(t, (F.col("pi") == YEAR) & (F.col("v") == 11))), f"select record_index from keys where pi = {YEAR} and v = 11")
    out["bit_planes"] = (
        k(lambda t: selection.shown(bits.planes(t, "v", 1)).withColumn("plane", F.col("plane").cast("long"))),
        selection.shown_sql("select plane, record_index from keys, range(8) as r(plane) where (v >> (7 - plane)) & 1 = 1", "plane"),
    )
    words = lambda: [F.col("record_index") * 8 + i for i in range(8)]
    out["byte_transpose"] = (
        k(lambda t: t.select("record_index", *(x.alias(f"w{i}") for i, x in enumerate(bits.transpose8(words()))))),
        "select record_index, " + ", ".join(f"(case when w{i} >= 9223372036854775808 then w{i} - 18446744073709551616 else w{i} end)::bigint as w{i}" for i in range(8)) + " from (select record_index, "
        + ", ".join(" + ".join(f"(((record_index * 8 + {r}) >> {8 * (7 - i)}) & 255)::hugeint * {1 << (8 * (7 - r))}" for r in range(8)) + f" as w{i}" for i in range(8)) + " from keys)",
    )
    x, y = (lambda: F.col("record_index")), pi
    arithmetic = {
        "and": (lambda: integers.bit_and(x(), y(), 2), "x & y"),
        "or": (lambda: integers.bit_or(x(), y(), 2), "x | y"),
        "xor": (lambda: integers.bit_xor(x(), y(), 2), "xor(x, y)"),
        "nand": (lambda: integers.bit_nand(x(), y(), 2), "65535 - (x & y)"),
        "nor": (lambda: integers.bit_nor(x(), y(), 2), "65535 - (x | y)"),
        "xnor": (lambda: integers.bit_xnor(x(), y(), 2), "65535 - xor(x, y)"),
        "add": (lambda: integers.add(x(), y(), 2), "(x + y) % 65536"),
        "sub": (lambda: integers.sub(x(), y(), 2), "(x - y + 65536) % 65536"),
        "mul": (lambda: integers.mul(x(), y(), 2), "(x * y) % 65536"),
        "not": (lambda: integers.bit_not(x(), 2), "65535 - x"),
        "increment": (lambda: integers.increment(x(), 2), "(x + 1) % 65536"),
        "shift_left": (lambda: integers.shift_left(x(), 3, 2), "(x * 8) % 65536"),
        "shift_right": (lambda: integers.shift_right(x(), 3, 2), "x // 8"),
        "is_zero": (lambda: integers.is_zero(x(), 2).cast("long"), "(x = 0)::bigint"),
        "all_ones": (lambda: integers.all_ones(x(), 2).cast("long"), "(x = 65535)::bigint"),
        "majority": (lambda: integers.majority(x(), y(), v()), "(x & y) | (y & v) | (v & x)"),
        "popcount": (lambda: integers.popcount(x()).cast("long"), "bit_count(x)::bigint"),
        "hash": (lambda: integers.bucket(x(), 1024), f"(({integers.HASH_FACTOR}::hugeint * x + {integers.HASH_OFFSET}) % 1024)::bigint"),
    }
    wrapped = ", keysx as (select record_index, record_index % 65536 as x, pi as y, v from keys) "
    for op in operators:
        arithmetic[f"compare_{op}"] = (lambda op=op: integers.compare_value(x(), op, 500, 2), f"(x {operators[op]} 500)::bigint")
    constants = {"and": (integers.bit_and, "x & 3855"), "xnor": (integers.bit_xnor, "65535 - xor(x, 3855)"), "add": (integers.add, "(x + 3855) % 65536"), "mul": (integers.mul, "(x * 3855) % 65536")}
    for name, (f, sql) in constants.items():
        arithmetic[f"{name}_constant"] = (lambda f=f: f(x(), 3855, 2), sql)
    mask = lambda: v() < 40
    under = {
        "add": (lambda: integers.add(x(), y(), 2, mask()), "(x + y) % 65536"),
        "mul_constant": (lambda: integers.mul(x(), 3855, 2, mask()), "(x * 3855) % 65536"),
        "not": (lambda: integers.bit_not(x(), 2, mask()), "65535 - x"),
        "shift_left": (lambda: integers.shift_left(x(), 3, 2, mask()), "(x * 8) % 65536"),
        "is_zero": (lambda: integers.is_zero(x(), 2, mask()), "(x = 0)::bigint"),
        "all_ones": (lambda: integers.all_ones(x(), 2, mask()), "(x = 65535)::bigint"),
        "majority": (lambda: integers.majority(x(), y(), v(), mask()), "(x & y) | (y & v) | (v & x)"),
        "popcount": (lambda: integers.popcount(x(), mask()), "bit_count(x)::bigint"),
        "hash": (lambda: integers.bucket(x(), 1024, mask()), f"(({integers.HASH_FACTOR}::hugeint * x + {integers.HASH_OFFSET}) % 1024)::bigint"),
        "compare_lt": (lambda: integers.compare_value(x(), "lt", 500, 2, mask()), "(x < 500)::bigint"),
    }
    arithmetic |= {f"{name}_masked": (f, f"case when v < 40 then {sql} else x end") for name, (f, sql) in under.items()}
    for name, (column, sql) in arithmetic.items():
        out[f"integer_{name}"] = (
            k(lambda t, column=column: t.withColumn("id", F.col("record_index")).withColumn("record_index", F.col("record_index") % 65536).select("id", column().alias("z"))),
            wrapped + f"select record_index as id, {sql} as z from keysx",
        )
    return out


def _drawn(s: SparkSession, rows: DataFrame) -> DataFrame:
    """What is sure of drawn columns: rows, values that are not null, least and greatest."""
    facts = [F.count("*").alias("n")]
    for c in ("pi", "data"):
        facts += [F.count(c).alias(f"n_{c}"), F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}")]
    return rows.agg(*facts)


def _drawn_sql(n: int, pi: tuple | None, data: tuple | None) -> str:
    part = lambda name, x: f"{n if x else 0}::bigint as n_{name}, {x[0] if x else 'null'}::bigint as low_{name}, {x[1] if x else 'null'}::bigint as high_{name}"
    return f"select {n}::bigint as n, {part('pi', pi)}, {part('data', data)}"


def _generators() -> dict:
    n, byte = 100_000, (0, 255)  # a byte's 256 values are all drawn among so many rows
    drawn = {"random_constant": (byte, (204, 204)), "incremental_constant": (byte, (204, 204)), "random_null": (byte, None), "incremental_null": (byte, None), "bounded_null": ((3, 9), None), "constant_random": ((204, 204), byte), "incremental_random": (byte, byte)}
    pairs = {f"generate_{name}": (lambda s, d, name=name: _drawn(s, generators.combination(s, name, n, 1, 3, 9)), _drawn_sql(n, *x)) for name, x in drawn.items()}
    single = {
        "generate_uniform": (lambda s, d: _drawn(s, generators.records(s, n, generators.uniform(10, 19, 5))), _drawn_sql(n, (10, 19), None)),
        "generate_uniform_width": (lambda s, d: _drawn(s, generators.records(s, n, generators.uniform_width(1, 5))), _drawn_sql(n, byte, None)),
    }
    return pairs | single | {
        "generate_constant": (lambda s, d: generators.records(s, 1000, generators.constant(204)), "select i as record_index, 204::bigint as pi, null::bigint as data from range(1000) as r(i)"),
        "generate_incremental": (lambda s, d: generators.records(s, 1000, generators.incremental(1)), "select i as record_index, i % 256 as pi, null::bigint as data from range(1000) as r(i)"),
        "generate_known_truth": (lambda s, d: generators.records(s, 8193, F.col("record_index"), F.col("record_index")), "select i as record_index, i as pi, i as data from range(8193) as r(i)"),
        "dictionary_codes": (
            lambda s, d: parquet(s, d, "region").select("r_name", encode(F.col("r_name"), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]).cast("long").alias("code")).withColumn("name", decode(F.col("code").cast("int"), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])),
            "select r_name, (list_position(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], r_name) - 1)::bigint as code, case when list_contains(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], r_name) then r_name end as name from region",
        ),
    }


def queries() -> dict:
    return {n: q for n, (q, _) in (_entries() | _generators()).items()}


def oracle_sql() -> dict[str, str]:
    w = f"with {KEYS_SQL}, {BUILD_SQL} "
    return {n: w + sql for n, (_, sql) in _entries().items()} | {n: sql for n, (_, sql) in _generators().items()}
