import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from colonnade.plans import catalog, layout, ssb
from colonnade.sources import generators, readers, schema
from colonnade.streaming import stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_generators_do_not_depend_on_partitions(spark):
    a = generators.combination(spark, "incremental_random", 1000, width=2)
    b = a.repartition(7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert [r.pi for r in generators.records(spark, 258, generators.incremental(1)).orderBy("record_index").collect()][254:] == [254, 255, 0, 1]
    values = {r.pi for r in generators.records(spark, 3000, generators.uniform(1990, 1999, 0)).collect()}
    assert values == set(range(1990, 2000))
    for name in generators.COMBINATIONS:
        assert generators.combination(spark, name, 10).count() == 10
    a, b = generators.sqb_tables(spark, 100, 10)
    assert a.where("a_b_k < 0 or a_b_k > 9 or a_10 > 9 or a_100 > 99").count() == 0 and b.count() == 10


def test_record_files(spark, tmp_path):
    rows = [(0, 5, None), (1, None, 7), (2, 9, 8)]
    df = spark.createDataFrame(rows, "record_index long, pi long, data long")
    readers.write_records(df, str(tmp_path / "r"), (4, 1))
    assert sorted(map(tuple, readers.read_records(spark, str(tmp_path / "r")).collect())) == rows
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert text.splitlines()[0] == "4\t1\t3"
    (tmp_path / "bad").write_text("4\t1\t5\n1 2\n")
    with pytest.raises(Exception, match="count is wrong"):
        readers.read_records(spark, str(tmp_path / "bad")).collect()


def test_tbl_and_tables(spark, tmp_path):
    (tmp_path / "s.tbl").write_text("1|Supplier#1|addr|UNITED KI1|UNITED KINGDOM|EUROPE|123|\n2|S|a|CHINA    0|CHINA|ASIA|9\n")
    rows = readers.tbl(spark, str(tmp_path / "s.tbl"), "supplier").orderBy("supplier_key")
    assert [(r.supplier_key, r.region) for r in rows.collect()] == [(1, "EUROPE"), (2, "ASIA")]
    codes = rows.select(readers.encode(F.col("city"), schema.cities()).alias("c"), readers.decode(readers.encode(F.col("nation"), schema.NATIONS), schema.NATIONS).alias("n")).collect()
    assert [(r.c, r.n) for r in codes] == [(231, "UNITED KINGDOM"), (180, "CHINA")]
    assert len(schema.cities()) == 250 and len(schema.brands()) == 1000 and schema.brands()[260:268] == [f"MFGR#22{k}" for k in range(21, 29)]
    readers.write_table(rows.select("supplier_key", "region"), str(tmp_path / "t"))
    assert readers.read_table(spark, str(tmp_path / "t"), "supplier_key int, region string").count() == 2


def test_join_orders_agree(spark, sf_dir):
    for name in ("q2_1", "q3_1", "q4_1"):
        results = [sorted(map(tuple, ssb.full(spark, sf_dir, name, o).collect())) for o in ssb.orders(ssb.QUERIES[name])]
        assert all(r == results[0] for r in results)


def test_plans_stay_in_the_jvm_and_prune(spark, sf_dir):
    for name, q in catalog.queries().items():
        if name.startswith(("ssb_q", "sqb_")) and "_by_" not in name:
            assert "Python" not in plan(q(spark, sf_dir)), name
    p = plan(catalog.queries()["sqb_semijoin_5"](spark, sf_dir))
    assert "BroadcastHashJoin" in p and "LeftSemi" in p
    p = plan(ssb.selection(spark, sf_dir, "q1_1"))
    assert "l_returnflag" not in p and "l_tax" not in p
    assert "CartesianProduct" not in p


def test_events_stream(spark, sf_dir, tmp_path):
    table = readers.parquet(spark, sf_dir, "events")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = stream.window_totals(stream.read(spark, str(tmp_path / "in"), table, 100), "ts", "event_type", "value", "1 day", "10 days", F.col("value") > 0)
    stream.write(rows, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = {(r.start, r.group): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.w.start, r.event_type): r.n for r in table.where("value > 0").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    # windows that the watermark has not passed yet are not written
    assert all(want[k] == n for k, n in got.items())


def test_layouts():
    plain = layout.Layout(record_bytes=2, hitmaps=1)
    n = plain.capacity()
    assert plain.data_rows(n) + plain.hitmap_rows(n) <= plain.bank.rows < plain.data_rows(n + 1) + plain.hitmap_rows(n + 1)
    assert layout.Layout(record_bytes=3).data_rows(342) == 2 and layout.Layout("packed", 3).data_rows(341) == 1
    assert layout.Layout("vertical", 2).data_rows(8193) == 32
    assert plain.capacity(1000) == 1000 and plain.regions(1000) == {"data": (0, 2), "hitmaps": (2, 1)}
    with pytest.raises(ValueError):
        layout.Layout(reserved_bytes=(33 << 20,)).capacity()
    assert layout.scan_ns(plain, 8192, vector=True) < layout.scan_ns(plain, 8192)
    assert layout.Bank().load_ns == 5 + 21 + 21 and layout.Bank().copy_ns == 63
    assert layout.bit_serial_ns(layout.Layout("vertical", 1), 8192) == 8 * (3 * 63 + 42)


def test_layout_settings(tmp_path):
    one = layout.Layout("vertical", 2, 1, (1024, 2048))
    one.save(str(tmp_path / "l.json"))
    assert layout.Layout.load(str(tmp_path / "l.json")) == one
    assert json.loads((tmp_path / "l.json").read_text())["record_bytes"] == 2


def test_entry_point_without_text_operators(tmp_path):
    """The rest works where the text subpackage and the pipeline are gone."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "colonnade"), tmp_path / "colonnade", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()) and not any(n.startswith('op1_') for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr


def test_predicates_reach_the_scan_and_dimensions_come_first(spark, sf_dir):
    from colonnade.plans import ssb

    def plan(df):
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    text = plan(ssb.full(spark, sf_dir, "q1_1"))
    pushed = [x for x in text.splitlines() if x.startswith("PushedFilters")]
    assert any("LessThanOrEqual(l_discount" in x and "LessThan(l_quantity" in x for x in pushed)
    assert any("GreaterThanOrEqual(o_orderdate" in x for x in pushed)
    for name in ("q2_1", "q4_3"):
        tree = ssb.full(spark, sf_dir, name)._jdf.queryExecution().optimizedPlan().toString()
        assert tree.count("part.parquet") <= 1 and tree.count("p_partkey#") > 0
        lines = tree.splitlines()
        depth = {k: next(i for i, x in enumerate(lines) if k in x) for k in ("(lo_orderkey#", "(lo_partkey#", "(lo_suppkey#")}
        assert depth["(lo_orderkey#"] < min(depth["(lo_partkey#"], depth["(lo_suppkey#"])  # the two sides meet above the dimensions


def test_the_calendar_has_all_its_days_and_a_known_size(spark, sf_dir):
    from colonnade.sources import views

    found = views.dates(spark, sf_dir).agg({"d_datekey": "min", "d_year": "max", "*": "count"}).first()
    assert tuple(sorted(map(int, found))) == (2099, 73049, 19000101)
