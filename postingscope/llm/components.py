"""Connected components of an edge table by alternating large and small stars.

Nodes and edges stay distributed; every round is two grouped minima and two equi-joins on the edges, which
shrink to one edge per node (node, smallest node of its component).  Rounds end when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    met = near.join(low, F.col("u") == F.col("w"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (u, v: bigint); root is the smallest node of the component."""
    state = cut(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    while True:
        mark = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        state = cut(_star(_star(state, True), False))
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
