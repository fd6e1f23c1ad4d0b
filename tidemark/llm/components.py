"""Connected components of a graph in tables, by alternating large-star and small-star steps.

Every step is an aggregate with map-side combination and an equi-join whose large partitions Spark can split, so a hub
needs no task of its own.  Each round is a table in the shared folder.  Rounds grow with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, materialize, partitions_of

#: Edges of a file at least, where there are so many; a round of a small graph is a few tasks, not one a partition.
FILE_EDGES = 50_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours above (large) or up to (small) each node to the least of its neighbourhood."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node with an edge to another; ``edges`` has a, b."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark or not new[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(new)
        files = min(partitions_of(edges.sparkSession), 1 + new[0] // FILE_EDGES)
        old, large = edges, materialize(_star(edges, True).coalesce(files), "edges")
        edges = materialize(_star(large, False).coalesce(files), "edges")
        discard(old, large)
