"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import checkpointed

#: A node of so many edges is no burden to one task; nodes of more, and of more than one edge
#: in HOT_SHARE, meet their edges by broadcast.
HOT_ROWS = 10_000


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) for all ends of edges (a, b); comp is the least node that is reached.

    Each round links every node to the least of its neighbourhood, first its greater
    neighbours, then its smaller ones; rounds grow with the logarithm of a component's breadth
    and go on until one moves nothing. Either half is one exchange and one sort; edges stay
    distributed and are cut from their lineage each round. Self-loops, repeats and edges
    without an end do no harm; no edges give no rows.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"), F.lit(True).alias("moved")).filter("hi <> lo").distinct())
    while (now := e.agg(F.count("*"), F.max("moved")).first())[1]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v"), F.lit(False).alias("moved")).union(e.select("lo", "hi", F.lit(False)))
        stars = _with_least(both, 2 * now[0]).withColumn("m", F.least("u", "m")).filter("v > u")
        large = stars.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
        if now[0] > HOT_ROWS:
            large = checkpointed(large)
        small = _with_least(large, now[0])
        hang = F.col("v") != F.col("m")
        e = checkpointed(small.select(F.when(hang, F.col("v")).otherwise(F.col("u")).alias("hi"), F.col("m").alias("lo"), (F.col("moved") | hang).alias("moved")))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(e.select("lo", "lo")).distinct()


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """Rows (u, v, moved) with m, the least v of their u; a pair that has stood before goes."""
    w = Window.partitionBy("u").orderBy("v")

    def ran(rows: DataFrame) -> DataFrame:
        least = F.first("v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.select("u", "v", "moved", least.alias("m"), F.lag("v").over(w).alias("before")).filter("before is null or before <> v or moved").drop("before")

    if total <= HOT_ROWS:
        return ran(rows)
    many = F.col("n") > max(HOT_ROWS, total // common.HOT_SHARE)
    hot = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).filter(many).select("u", "m").collect()
    if not hot:
        return ran(rows)
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, "u bigint, m bigint"))
    return rows.join(few, "u").select("u", "v", "moved", "m").unionByName(ran(rows.join(few, "u", "left_anti")))
