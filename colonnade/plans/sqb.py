"""The select, semi-join, join and aggregate suite over A and B, in the output forms of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.predicates import compare
from colonnade.operators import aggregates, emit, joins, selection
from colonnade.sources import views
from colonnade.sources.readers import parquet

THRESHOLDS = (1, 5, 25)


def _a(spark: SparkSession, d: str) -> DataFrame:
    return views.sqb_a(spark, d)


def _b(spark: SparkSession, d: str, v: int, *payload: str) -> DataFrame:
    """Keys (and payload) of B under the threshold, for the build side."""
    return joins.build_side(views.sqb_b(spark, d).where(compare(F.col("b_100"), "lt", v, 1)).select("b_k", *payload), parquet(spark, d, "customer"))


def select_values(spark: SparkSession, d: str, v: int) -> DataFrame:
    return emit.values(_a(spark, d), compare(F.col("a_100"), "lt", v, 1), "record_index", "a_10")


def select_index(spark: SparkSession, d: str, v: int) -> DataFrame:
    return selection.positions(_a(spark, d), compare(F.col("a_100"), "lt", v, 1))


def select_bitmap(spark: SparkSession, d: str, v: int) -> DataFrame:
    return selection.shown(selection.bitmaps(_a(spark, d), compare(F.col("a_100"), "lt", v, 1)))


def semijoin_values(spark: SparkSession, d: str, v: int) -> DataFrame:
    return joins.semi(_a(spark, d), _b(spark, d, v), "a_b_k", "b_k").select("record_index", "a_10")


def semijoin_index(spark: SparkSession, d: str, v: int) -> DataFrame:
    return joins.index_join(_a(spark, d), _b(spark, d, v), "a_b_k", "b_k")


def _hits(spark: SparkSession, d: str, v: int) -> DataFrame:
    """Bitmaps of the rows of A whose key B has under the threshold."""
    return selection.bitmaps(joins.semi(_a(spark, d), _b(spark, d, v), "a_b_k", "b_k"), F.lit(True))


def semijoin_bitmap(spark: SparkSession, d: str, v: int) -> DataFrame:
    return selection.shown(_hits(spark, d, v))


def join(spark: SparkSession, d: str, v: int) -> DataFrame:
    return joins.payload_join(_a(spark, d), _b(spark, d, v, "b_10"), "a_b_k", "b_k").select("record_index", "a_10", "b_10")


def aggregate(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.total(_a(spark, d), "a_10")


def group_by_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.group_total(_a(spark, d), "a_100", "a_10", dense=100)


def semijoin_sum(spark: SparkSession, d: str, v: int) -> DataFrame:
    return aggregates.total(joins.semi(_a(spark, d), _b(spark, d, v), "a_b_k", "b_k"), "a_100")


def join_group_sum(spark: SparkSession, d: str, v: int) -> DataFrame:
    return aggregates.group_total(joins.payload_join(_a(spark, d), _b(spark, d, v, "b_10"), "a_b_k", "b_k"), "b_10", "a_10")


def join_group_sum_bitmap(spark: SparkSession, d: str, v: int) -> DataFrame:
    """The semi join leaves bitmaps; the rows they hold fetch their payload and are summed."""
    rows = selection.consume(_a(spark, d), _hits(spark, d, v))
    return aggregates.group_total(joins.payload_join(rows, _b(spark, d, v, "b_10"), "a_b_k", "b_k"), "b_10", "a_10")


def join_group_sum_hitmap(spark: SparkSession, d: str, v: int) -> DataFrame:
    """The semi join leaves a boolean for every row, which is the mask of the join."""
    rows = joins.semi_flags(_a(spark, d), _b(spark, d, v), "a_b_k", "b_k", name="hit")
    return aggregates.group_total(joins.payload_join(rows, _b(spark, d, v, "b_10"), "a_b_k", "b_k", F.col("hit")), "b_10", "a_10")


def join_group_sum_index(spark: SparkSession, d: str, v: int) -> DataFrame:
    """The join leaves (index, payload) pairs; values are fetched by index and summed."""
    pairs = joins.index_payload_join(_a(spark, d), _b(spark, d, v, "b_10"), "a_b_k", "b_k", "b_10").withColumnRenamed("record_index", "at")
    rows = _a(spark, d).select("record_index", "a_10").join(pairs, F.col("record_index") == F.col("at"))
    return aggregates.group_total(rows, "payload", "a_10")


def queries() -> dict:
    each = {"select": select_values, "select_index": select_index, "select_bitmap": select_bitmap, "semijoin": semijoin_values, "semijoin_index": semijoin_index, "semijoin_bitmap": semijoin_bitmap, "join": join, "semijoin_sum": semijoin_sum, "join_group_sum": join_group_sum}
    each |= {"join_group_sum_bitmap": join_group_sum_bitmap, "join_group_sum_hitmap": join_group_sum_hitmap, "join_group_sum_index": join_group_sum_index}
    out = {f"sqb_{n}_{v}": (lambda s, d, f=f, v=v: f(s, d, v)) for n, f in each.items() for v in THRESHOLDS}
    return out | {"sqb_aggregate": aggregate, "sqb_group_by_aggregate": group_by_aggregate}


def oracle_sql() -> dict[str, str]:
    w = f"with {views.SQB_SQL} "
    each = {
        "select": "select record_index, a_10 from a where a_100 < {v}",
        "select_index": "select record_index from a where a_100 < {v}",
        "select_bitmap": selection.shown_sql("select record_index from a where a_100 < {v}"),
        "semijoin_bitmap": selection.shown_sql("select record_index from a where a_b_k in (select b_k from b where b_100 < {v})"),
        "semijoin": "select record_index, a_10 from a where a_b_k in (select b_k from b where b_100 < {v})",
        "semijoin_index": "select record_index from a where a_b_k in (select b_k from b where b_100 < {v})",
        "join": "select a.record_index, a_10, b_10 from a join b on a_b_k = b_k where b_100 < {v}",
        "semijoin_sum": "select coalesce(sum(a_100), 0)::bigint as total from a where a_b_k in (select b_k from b where b_100 < {v})",
        "join_group_sum": 'select b_10 as "group", sum(a_10)::bigint as total from a join b on a_b_k = b_k where b_100 < {v} group by 1',
    }
    each |= {f"join_group_sum_{form}": each["join_group_sum"] for form in ("bitmap", "hitmap", "index")}
    out = {f"sqb_{n}_{v}": w + q.replace("{v}", str(v)) for n, q in each.items() for v in THRESHOLDS}
    out["sqb_aggregate"] = w + "select sum(a_10)::bigint as total from a"
    out["sqb_group_by_aggregate"] = w + 'select g as "group", coalesce(sum(a_10), 0)::bigint as total from range(100) as r(g) left join a on a_100 = g group by g'
    return out
