import random

import pytest
from pyspark.sql import functions as F

from colonnade.functions import bits, integers
from colonnade.functions.predicates import COMPARISONS, between, compare, inverse, subfield
from colonnade.operators import aggregates, emit, hashstats, joins, selection
from colonnade.sources import generators

EDGES = {1: [0, 1, 127, 128, 254, 255], 2: [0, 1994, 1995, 1996, 65535], 4: [0, 2**31 - 1, 2**31, 2**32 - 1]}


def frame(spark, values, name="pi"):
    return spark.createDataFrame(list(enumerate(values)), f"record_index long, {name} long")


def found(df, column="record_index"):
    return sorted(r[column] for r in df.collect())


@pytest.mark.parametrize("width", EDGES)
@pytest.mark.parametrize("op", COMPARISONS)
def test_comparisons_at_the_edges(spark, width, op):
    values = EDGES[width]
    df = frame(spark, values)
    for v in values:
        want = [i for i, x in enumerate(values) if COMPARISONS[op](x, v)]
        assert found(selection.positions(df, compare(F.col("pi"), op, v, width))) == want
        assert found(selection.positions(df, bits.serial_compare(F.col("pi"), op, v, width))) == want


def test_value_must_fit_its_width():
    with pytest.raises(ValueError):
        compare(F.lit(1), "lt", 256, 1)
    with pytest.raises(ValueError):
        compare(F.lit(1), "about", 2)
    with pytest.raises(ValueError):
        between(F.lit(1), 0, 1, "left")


def test_between_closed_and_open(spark):
    df = frame(spark, range(6))
    assert found(selection.positions(df, between(F.col("pi"), 1, 4))) == [1, 2, 3, 4]
    assert found(selection.positions(df, between(F.col("pi"), 1, 4, "neither"))) == [2, 3]


def test_negation_with_a_prior_selection(spark):
    df = frame(spark, range(4))
    p, prior = F.col("pi") < 2, F.col("pi") % 2 == 0
    assert found(selection.positions(df, inverse(p, prior))) == [2]
    assert found(selection.positions(df, inverse(p, prior, negate_conjunction=True))) == [1, 2, 3]
    assert found(selection.positions(df, inverse(p))) == [2, 3]


def test_subfield(spark):
    df = frame(spark, [0x0102030405060708, 0x1102FF0405060708])
    rows = df.select(subfield(F.col("pi"), 8, 2, 1).alias("a"), subfield(F.col("pi"), 8, 0, 8).alias("b"), subfield(F.col("pi"), 8, 6, 2).alias("c")).collect()
    assert [tuple(r) for r in rows] == [(3, 0x0102030405060708, 0x0708), (255, 0x1102FF0405060708, 0x0708)]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 8191, 8192, 8193, 32767, 32768, 32769])
def test_bitmaps_hold_the_positions(spark, n):
    df = spark.range(n).withColumnRenamed("id", "record_index")
    third, fifth = F.col("record_index") % 3 == 0, F.col("record_index") % 5 == 0
    a, b = selection.bitmaps(df, third), selection.bitmaps(df, fifth)
    assert found(selection.unpack(a), "position") == list(range(0, n, 3))
    assert found(selection.unpack(selection.bitmap_and(a, b)), "position") == list(range(0, n, 15))
    assert found(selection.unpack(selection.bitmap_or(a, b)), "position") == [i for i in range(n) if i % 3 == 0 or i % 5 == 0]
    assert found(selection.unpack(selection.bitmap_not(a, df)), "position") == [i for i in range(n) if i % 3]
    assert selection.bitmap_count(a).first()[0] == len(range(0, n, 3)) == selection.count(df, third).first()[0]


def test_empty_and_full_selections(spark):
    df = frame(spark, range(10))
    assert found(selection.positions(df, F.lit(False))) == [] and selection.count(df, F.lit(False)).first()[0] == 0
    assert found(selection.positions(df, F.lit(True))) == list(range(10))
    assert [r.sel for r in selection.flags(df, F.lit(None).cast("boolean")).collect()] == [False] * 10


def test_integers_match_python(spark):
    rng = random.Random(3)
    for width in (1, 2, 3, 4, 6):
        top = 1 << (8 * width)
        pairs = [(rng.randrange(top), rng.randrange(top)) for _ in range(40)] + [(0, 0), (top - 1, top - 1), (top - 1, 1), (0, top - 1)]
        df = spark.createDataFrame(pairs, "a long, b long")
        a, b = F.col("a"), F.col("b")
        columns = {
            "and": (integers.bit_and(a, b, width), lambda x, y: x & y),
            "nand": (integers.bit_nand(a, b, width), lambda x, y: ~(x & y) % top),
            "nor": (integers.bit_nor(a, b, width), lambda x, y: ~(x | y) % top),
            "xnor": (integers.bit_xnor(a, b, width), lambda x, y: ~(x ^ y) % top),
            "add": (integers.add(a, b, width), lambda x, y: (x + y) % top),
            "sub": (integers.sub(a, b, width), lambda x, y: (x - y) % top),
            "mul": (integers.mul(a, b, width), lambda x, y: x * y % top),
            "not": (integers.bit_not(a, width), lambda x, y: ~x % top),
            "left": (integers.shift_left(a, 5, width), lambda x, y: (x << 5) % top),
            "right": (integers.shift_right(a, 5, width), lambda x, y: x >> 5),
            "masked": (integers.add(a, b, width, b % 2 == 0), lambda x, y: (x + y) % top if y % 2 == 0 else x),
            "hash": (integers.bucket(a, 1024), lambda x, y: (3634946921 * x + 2096170329) & 1023),
        }
        for r in df.select("a", "b", *(c.alias(n) for n, (c, _) in columns.items())).collect():
            for name, (_, f) in columns.items():
                assert r[name] == f(r.a, r.b), (name, width, r)


def test_transpose_twice_is_the_same(spark):
    rng = random.Random(8)
    words = [[rng.getrandbits(63) for _ in range(8)] for _ in range(5)]
    df = spark.createDataFrame(words, ", ".join(f"w{i} long" for i in range(8)))
    once = df.select(*(c.alias(f"w{i}") for i, c in enumerate(bits.transpose8([F.col(f"w{i}") for i in range(8)]))))
    twice = once.select(*(c.alias(f"w{i}") for i, c in enumerate(bits.transpose8([F.col(f"w{i}") for i in range(8)]))))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, words))


def test_duplicate_build_keys(spark):
    build = spark.createDataFrame([(5, 1, 10), (5, 2, 3), (6, 7, 4)], "key long, payload long, record_index long")
    first = joins.unique_build(build, "key", "payload")
    assert sorted(map(tuple, first.collect())) == [(5, 2), (6, 7)]
    with pytest.raises(Exception, match="twice"):
        joins.unique_build(build, "key", "payload", check=True).collect()
    assert joins.unique_build(build.where("key = 6"), "key", "payload", check=True).count() == 1
    probe = frame(spark, [5, 6, 7, 5])
    assert sorted(map(tuple, joins.index_payload_join(probe, first, "pi", "key", "payload").collect())) == [(0, 2), (1, 7), (3, 2)]
    assert found(joins.index_join(probe, build, "pi", "key", F.col("record_index") > 0)) == [1, 3]
    assert [r.sel for r in joins.semi_flags(probe, first, "pi", "key").orderBy("record_index").collect()] == [True, True, False, True]
    assert sorted((r.record_index, r.payload) for r in joins.lookup(probe, first, "pi", "key", "payload").collect()) == [(0, 2), (1, 7), (2, None), (3, 2)]


def test_null_keys_never_hit(spark):
    probe = spark.createDataFrame([(0, None), (1, 5)], "record_index long, pi long")
    build = spark.createDataFrame([(None, 1), (5, 2)], "key long, payload long")
    assert found(joins.semi(probe, build, "pi", "key")) == [1]
    assert sorted((r.record_index, r.sel) for r in joins.semi_flags(probe, build, "pi", "key").collect()) == [(0, False), (1, True)]


def test_emit_payload_of_known_positions(spark):
    probe = generators.records(spark, 8192, F.col("record_index"))
    build = spark.createDataFrame([(0, 999), (1, 998), (8191, 997), (8193, 996)], "key long, payload long")
    rows = emit.payloads(probe, F.col("record_index").isin(0, 1, 8191), build, "pi", "key", "payload")
    assert [tuple(r) for r in rows.orderBy("record_index").collect()] == [(0, 999), (1, 998), (8191, 997)]
    with pytest.raises(Exception, match="no payload for key 2"):
        emit.payloads(probe, F.col("record_index") == 2, build, "pi", "key", "payload").collect()
    # a payload that is null is no missing key
    nothing = spark.createDataFrame([(2, None)], "key long, payload long")
    assert emit.payloads(probe, F.col("record_index") == 2, nothing, "pi", "key", "payload").first().payload is None


def test_emit_values_in_order(spark):
    df = generators.records(spark, 8193, F.col("record_index"), F.col("record_index") * 2)
    assert [r.data for r in emit.values(df, F.col("pi") % 4096 == 0, "data", ordered=True).collect()] == [0, 8192, 16384]


def test_sums(spark):
    ones = generators.records(spark, 89411, generators.constant(1))
    assert aggregates.total(ones, "pi").first()[0] == 89411
    assert aggregates.total(ones, "pi", 1).first()[0] == 89411 % 256
    assert aggregates.total(ones.limit(0), "pi").first()[0] == 0
    groups = spark.createDataFrame([(1, 5), (1, 6), (3, 7)], "g int, x int")
    assert sorted(map(tuple, aggregates.group_total(groups, "g", "x").collect())) == [(1, 11), (3, 7)]
    assert sorted(map(tuple, aggregates.group_total(groups, "g", "x", 5).collect())) == [(0, 0), (1, 11), (2, 0), (3, 7), (4, 0)]


def test_hash_tables_as_chains_would_be(spark):
    keys = random.Random(1).sample(range(1 << 32), 300)
    df = frame(spark, keys, "k")
    chains: dict = {}
    for k in keys:
        chains.setdefault((3634946921 * k + 2096170329) & 15, []).append(k)
    s = hashstats.statistics(df, "k", 16, 4).first()
    extra = sum(-(-len(c) // 4) - 1 for c in chains.values())
    assert (s.total_records, s.buckets, s.longest_record_chain) == (300, 16 + extra, max(map(len, chains.values())))
    assert sum(r.buckets for r in hashstats.histogram(df, "k", 16, 4).collect()) == 16
    probe = frame(spark, keys[:50] + [1, 2, 3], "p")
    for r in hashstats.traced(probe, "p", df, "k", 16, 4).collect():
        chain = chains.get((3634946921 * r.p + 2096170329) & 15, [])
        at = chain.index(r.p) + 1 if r.p in chain else None
        assert (r.hit, r.compares, r.buckets_visited) == (at is not None, at or len(chain) or 1, -(-(at or len(chain) or 1) // 4))


def test_de_morgan_and_partition_of_unity(spark):
    df = generators.records(spark, 5000, generators.uniform(1990, 1999, 4))
    a, b = compare(F.col("pi"), "lt", 1995), compare(F.col("pi"), "eq", 1993)
    assert found(selection.positions(df, ~(a & b))) == found(selection.positions(df, ~a | ~b))
    assert len(found(selection.positions(df, a))) + len(found(selection.positions(df, compare(F.col("pi"), "ge", 1995)))) == 5000
