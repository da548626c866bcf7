"""Times the headline queries. Prints one line of JSON: seconds in all and by query, each the median of three runs after a pass over all of them.

"generated" in that line times the select-join-aggregate suite over 10^8 x 10^6 generated rows (BENCH_ROWS; 0 leaves it out), the size of the
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.operators import aggregates, emit, joins, selection
from colonnade.plans import catalog
from colonnade.sources import generators

HEADLINE = [
    *(f"sqb_{q}_{t}" for t in (1, 5, 25) for q in ("select", "select_index", "select_bitmap", "semijoin", "semijoin_index", "semijoin_bitmap", "join")),
    "sqb_aggregate",
    "sqb_group_by_aggregate",
    "sqb_semijoin_sum_5",
    "sqb_join_group_sum_5",
    "consume_bitmap",
    "consume_indices",
    *(f"ssb_q{f}_{n}" for f, last in ((1, 3), (2, 3), (3, 4), (4, 3)) for n in range(1, last + 1)),
]
REPEATS = 3


def generated(spark: SparkSession, rows: int) -> dict[str, DataFrame]:
    a, b = generators.sqb_tables(spark, rows, max(1, rows // 100))
    out = {"read": a.select(F.max("a_100"), F.max("a_10"))}
    for t in (1, 5, 25):
        hit = F.col("a_100") < t
        keys = joins.build_side(b.where(F.col("b_100") < t).select("b_k"))
        paid = joins.build_side(b.where(F.col("b_100") < t).select("b_k", "b_10"))
        out[f"select_{t}"] = emit.values(a, hit, "record_index", "a_10")
        out[f"select_index_{t}"] = selection.positions(a, hit)
        out[f"select_bitmap_{t}"] = selection.bitmaps(a, hit)
        out[f"semijoin_index_{t}"] = joins.index_join(a, keys, "a_b_k", "b_k")
        out[f"semijoin_bitmap_{t}"] = selection.bitmaps(joins.semi(a, keys, "a_b_k", "b_k"), F.lit(True))
        out[f"join_{t}"] = joins.payload_join(a, paid, "a_b_k", "b_k").select("record_index", "a_10", "b_10")
    out["aggregate"] = aggregates.total(a, "a_10")
    out["group_by_aggregate"] = aggregates.group_total(a, "a_100", "a_10", dense=100)
    return out


def seconds_of(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = catalog.queries(), {}
    for name in HEADLINE:  # compiles what all queries share
        seconds_of(found[name](spark, sf_dir))
    for name in HEADLINE:
        runs = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            seconds_of(found[name](spark, sf_dir))
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs), 4)
    rows = int(os.environ.get("BENCH_ROWS", 100_000_000))
    large = {n: round(min(seconds_of(q) for _ in range(2)), 4) for n, q in generated(spark, rows).items()} if rows else {}
    spark.stop()
    out = {"metric": "seconds for all headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "generated": large, "generated_rows": rows}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
