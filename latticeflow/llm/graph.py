"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(near: DataFrame) -> DataFrame:
    """``near`` (u, v) with the least neighbour of u, u itself included, as m.

    The least neighbours are aggregated before the shuffle, and the join's large keys can be split, so a hub is no bottleneck.
    """
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return near.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for every node of an edge table ``(u, v)``: root is the least node reachable. Nulls are ignored.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    now, before = cut(now, "edges"), None
    while True:
        check = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not check["n"] or check == before:
            return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root"))).distinct()
        before = check
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = cut(now, "edges")
