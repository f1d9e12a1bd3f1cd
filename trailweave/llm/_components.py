"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (``u``, ``v``) with v < u; links each node's larger (or, else, smaller) neighbours to the least one."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For each node of edges (``u``, ``v``), its ``node`` and ``root``, the least node of its component.

    The edges come from, and every round goes to, a written table; only counts reach the driver.  A hot node's edges
    are aggregated before they are shuffled, and its join is one that Spark may split.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges = stored(edges)
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        after = stored(_star(_star(edges, True), False))
        drop(edges)
        edges = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(nodes.select(F.col("root").alias("node"), "root").distinct())
