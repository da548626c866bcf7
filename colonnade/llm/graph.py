"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import drop, materialise


def _with_least(links: DataFrame) -> DataFrame:
    """Both directions of the links (u, v), each with m, the least of u and all its neighbours."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (u long, v long); component is the least node reachable.

    Large-star and small-star steps alternate until the links form stars; each is a grouped minimum, which combines before
    the exchange, and a join that adaptive execution can split at a hub. Each round is written to the shared folder.
    Links with a null end or two equal ends say nothing; repeated links count once; no links give no rows.
    """
    links = links.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialise(links, "links")
    before = None
    while True:
        large = _with_least(links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        new = materialise(small, "links")
        drop(links)
        links = new
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
        before = now
