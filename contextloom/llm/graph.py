"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.runtime import cut

_MAX_ROUNDS = 60


def _with_least(rows: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """rows joined with (a, m) of their node a. A node of at least `hub` neighbours gets its m by broadcast, so its rows stay
    where they are; hub is a thousandth of the edges or more, so there are two thousand such nodes at most."""
    large = F.broadcast(least.where(F.col("n") >= hub).select("a", F.col("m").alias("hm")))
    marked = rows.join(large, "a", "left")
    fast = marked.where(F.col("hm").isNotNull()).select("a", "b", F.col("hm").alias("m"))
    return fast.unionByName(marked.where(F.col("hm").isNull()).select("a", "b").join(least.where(F.col("n") < hub).select("a", "m"), "a"))


def _star(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """Hang neighbours on the least neighbour: larger ones (large star), or smaller ones and the node itself.

    The least neighbour comes from a pre-aggregated groupBy, so a node with very many neighbours needs no buffer."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        out = _with_least(both.where(F.col("b") > F.col("a")), least, hub).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        out = _with_least(edges, least, hub).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), two longs: root is the least node that it is connected with.

    Only nodes with an edge to another node are returned. Lineage is cut after each round; the driver sees a count and a
    checksum. An empty table gives an empty table."""
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(e)
    for _ in range(_MAX_ROUNDS):
        if not seen[0]:
            break
        hub = max(100, seen[0] // 1000)
        e = cut(_star(cut(_star(e, True, hub)), False, hub))
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
