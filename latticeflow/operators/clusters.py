"""Clusters of sequences, their statistics, and annotations from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import greedy, joins


def exact_clusters(df: DataFrame, key: str, sequence: str, order: Column | None = None) -> DataFrame:
    """``(key, cluster)``: rows of equal sequences form a cluster named by its first key (by ``order``, else the least key)."""
    first = df.groupBy(sequence).agg(F.min_by(key, order if order is not None else F.col(key)).alias("cluster"))
    return df.select(key, sequence).join(first, df[sequence].eqNullSafe(first[sequence])).select(key, "cluster")


def homology_clusters(df: DataFrame, key: str, sequence: str, least: float = 0.70) -> DataFrame:
    """``(key, cluster)``: greedy clusters, longest sequences first; a member shares a k-mer and ``least`` identity with its centre.

    This is an approximation by position-wise identity, without alignment, of linear-time clustering programs.
    """
    rows = df.select(F.col(key).alias("id"), (-F.char_length(sequence)).alias("priority"))
    pairs = joins.kmer_conflicts(df, key, sequence, sequence, least=least, least_ratio=least)
    chosen = greedy.independent_set(rows, pairs.select("a", "b"), "id", "priority")
    return chosen.select(F.col("id").alias(key), F.coalesce("by", "id").alias("cluster"))


def cluster_stats(clusters: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: members, clusters, singletons and the sizes' minimum, median, mean and maximum."""
    sizes = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").alias("members"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"),
        F.min("n").alias("smallest"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("largest"),
    )


def largest(clusters: DataFrame, cluster: str = "cluster", top: int = 10) -> DataFrame:
    return clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), cluster).limit(top)


def annotated(df: DataFrame, keys: DataFrame, clusters: DataFrame, by: list[str], key: str) -> DataFrame:
    """Two left joins: rows to their sequence key, and the key to its cluster; a row without either keeps nulls."""
    return df.join(keys, by, "left").join(clusters, key, "left")
