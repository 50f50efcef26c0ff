"""Connected components of an edge table by alternating large and small stars, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, root`` for every id of ``edges (a, b)``; ``root`` is the smallest id of its component.

    Each round is two aggregations and joins whose map-side combine keeps a hub's edges out of one
    task; rounds grow with the logarithm of the longest path. It ends when every edge leads from a
    node with no other edge up to a root. Every round's table is written, and the one before removed.
    """
    now = shared.written(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct(), "edges")
    for _ in range(most_rounds):
        ends = now.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("lo", F.lit(0), F.lit(1)))
        if not shared.some(ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1")):
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())
        # large star: larger neighbours move to the smallest neighbour
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        # small star: smaller neighbours and the node itself move to the smallest neighbour
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        after = shared.written(small.select(F.col("m").alias("lo"), "hi").union(small.select("m", "lo")).where("lo <> hi").distinct(), "edges")
        shared.forget(now)
        now = after
    raise RuntimeError("components did not settle")
