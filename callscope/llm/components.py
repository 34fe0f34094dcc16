"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import settle


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another; component is its smallest reachable node.

    Alternates large-star and small-star steps (Kiveris et al. 2014), so the number of
    rounds grows with the logarithm of the longest chain.  Minima are aggregated before
    they are joined back, both sides of each join are plain exchanges that AQE can
    split when a node is hot, and each round is checkpointed.  Null ends and loops are
    ignored; no links give no rows.
    """
    u, v = F.col("u"), F.col("v")
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = settle(ends.where(u != v).distinct())
    was = _mark(edges)
    while was[0]:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # Each larger neighbour of u is linked to the smallest of u's neighbourhood.
        large = edges.select(v.alias("u"), u.alias("v")).join(low, "u").select(v.alias("u"), F.col("m").alias("v"))
        large = settle(large.where(u != v).distinct())
        # Each u and its smaller neighbours are linked to the smallest of these.
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = settle(small.where(u != v).distinct())
        now = _mark(edges)
        if now == was:
            break
        was = now
    return edges.select(u.alias("node"), v.alias("component")).unionByName(edges.select(v.alias("node"), v.alias("component")).distinct())
