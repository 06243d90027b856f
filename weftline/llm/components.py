"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._arrow import kept


def components(edges: DataFrame, folder: str, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of undirected ``edges`` (a, b); a component is named by its smallest node.

    Each round writes its edges to the shared folder; a hub's neighbours are handled by aggregates and a join, not as a list.
    Edges that still change after the last round are an error, not a result.
    """
    edges = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}-0")
    before = None
    for k in range(1, rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours under a node and the node itself go to the smallest of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small_least.select("a", F.col("m").alias("b"))).distinct()
        edges = kept(small, folder, f"{name}-{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components still change after {rounds - 1} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
