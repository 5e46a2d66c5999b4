"""Connected components of a table of links, by alternating large-star and small-star steps (joins and grouped minima)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.llm.common import BROADCAST_ROWS, cut, discard

#: Edges of a node from which on it is a hub: its row goes to its edges, not its edges to one task.
HUB = 10_000


def _beside(edges: DataFrame, nodes: DataFrame, key: str, n_edges: int) -> DataFrame:
    """``edges`` joined to ``nodes`` (one row a key, with ``edges_here``, the number of its edges) on ``key``.

    The edges of a hub never meet in one task: hubs are broadcast. There are 2 * n_edges / hub of them at most, so the bound of a
    broadcast holds by arithmetic; where all nodes are within it, all are broadcast."""
    if 2 * n_edges <= BROADCAST_ROWS // 4:
        return edges.join(F.broadcast(nodes), key)
    hub = max(HUB, 8 * n_edges // BROADCAST_ROWS)
    hubs = F.broadcast(nodes.filter(F.col("edges_here") > hub))
    return edges.join(hubs, key).unionByName(edges.join(hubs, key, "left_anti").join(nodes.filter(F.col("edges_here") <= hub), key))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b of one type; null ends and loops are left out): root is the least
    node of its component, and the least node has a row too. Nothing of the links comes to the driver but two sums a round."""
    e = links.select("a", "b").dropna().filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    e = cut(e)
    sums = lambda: e.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    seen = sums()
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.least(F.min("m"), F.first("v")).alias("low"), F.count("*").alias("edges_here"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = _beside(e.select(F.col("m").alias("_u"), F.col("v").alias("_n")), low.withColumnRenamed("v", "_u"), "_u", seen[0])
        large = cut(large.select(F.col("_n").alias("v"), F.col("low").alias("m")).distinct())
        # small star: a node and its neighbours below go to the least of them
        least = large.groupBy("v").agg(F.min("m").alias("low"), F.count("*").alias("edges_here"))
        small = _beside(large, least, "v", seen[0]).filter("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        before, e = e, cut(small.unionByName(least.select("v", F.col("low").alias("m"))).distinct())
        discard(before, large)
        now = sums()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle; raise rounds")
    top = e.select(F.col("m").alias("node")).distinct()
    return e.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(top.select("node", F.col("node").alias("root")))
