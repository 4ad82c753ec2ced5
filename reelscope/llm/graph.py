"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step joins edges with the least neighbour of a node. A hub may have a third of all edges, so edges are dealt by node and by a
slice of the other end, and a node's row is copied to the slices that it has edges in. Each round is written to the shared folder, so
a lost executor costs that round only. The driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, scratch, written


#: Slices that a node's edges are dealt into.
SLICES = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v of their u."""
    dealt = edges.withColumn("slice", F.pmod(F.xxhash64("v"), F.lit(SLICES)))
    least = dealt.groupBy("u", "slice").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_list("slice").alias("slices"))
    return dealt.join(least.select("u", "m", F.explode("slices").alias("slice")), ["u", "slice"]).drop("slice")


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (u, v) with v < u: each node's larger neighbours go to the least of the node and its neighbours."""
    both = _with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return both.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    moved = _with_least(edges)
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def _unsettled(edges: DataFrame) -> int:
    """Nodes that have two parents, or a parent and a child; none once every component is one star."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("u").alias("id"), one.alias("up"), none.alias("down")).unionByName(edges.select(F.col("v").alias("id"), none.alias("up"), one.alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").count()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node id reachable) for every node of links (a, b). Nodes without a link are not in it.

    Links may repeat, go either way or join a node to itself; rows with a null end are no links.
    """
    edges, last = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u <> v"), None
    with scratch() as kept:
        while last is None or _unsettled(edges):
            edges = written(_small_star(_large_star(edges)), "links", narrow=True)
            if last is not None:
                drop_written(last)
            last = edges
        found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        kept.append(written(found, "components", narrow=True))
    return kept[0]
