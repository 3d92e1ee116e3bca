"""Connected components by alternating large-star and small-star steps over staged edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeforge.llm.runtime import staged


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, steps: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (a, b); root: the least node reachable.

    A node's neighbours meet only in map-side minima and in joins, whose hot keys Spark can split; no
    neighbourhood, edge or component is held by one task or the driver.
    """
    one_way = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(one_way, "edges")
    seen = _digest(now)
    for _ in range(steps):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        now = staged(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges-large")
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        moved = now.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges-small")
        before, seen = seen, _digest(now)
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
