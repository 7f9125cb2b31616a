"""Connected components of a graph given by links, by alternating large-star and small-star steps.

No node's links come together in one task: each step is a partially aggregated minimum and a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, settled


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) for every node of links (a, b). Loops, repeats and both directions may occur; nulls are dropped."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = settled(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(a.alias("a"), b.alias("b")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = edges.join(least, "b").select("a", F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, edges = edges, settled(small.distinct(), "links")
        discard(last)
        if (new := _mark(edges)) == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame):
    """Number of edges and an order-free checksum."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
