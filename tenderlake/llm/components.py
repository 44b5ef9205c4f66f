"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on rows (u, v).

    Large: every neighbour above u is linked to the least of u and its
    neighbours. Small: u and its neighbours below it are linked to the least.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written before it is joined: adaptive execution can then split the links of a node that has a large share of them
    low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    linked = both.join(low, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``; root is the least node reachable.

    Edges may repeat and point either way; loops and nulls are dropped. Each
    round is written to the shared folder; no links reach the driver. The
    rounds grow with the logarithm of the nodes; ``most`` only guards against
    a fault and raises.
    """
    now = materialise(edges.select("u", "v").filter("u != v").distinct(), "links")
    before = None
    for _ in range(most):
        raised = materialise(_star(now, True), "links")
        now = materialise(_star(raised, False), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = seen
    raise RuntimeError("components did not settle")
