"""Connected components by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


#: Links that one task of a round writes.
ROWS_OF_A_FILE = 100_000


def _large_star(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    # Written, so that the join is fed by plain exchanges: the rows of a hub can be split.
    low = workspace.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest."""
    low = workspace.save(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    moved = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """node, root (the smallest node that can be reached) for every node of an edge.

    ``edges`` has two columns of one orderable type.  Each round is a constant
    number of shuffles whose aggregates combine on the map side; it is written
    to the shared folder, and only a count and a checksum reach the driver.
    """
    a, b = edges.columns
    current = workspace.save(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    seen, n = None, current.count()
    # Rounds keep the number of links at most; few of them fit into few files.
    few = max(1, n // ROWS_OF_A_FILE)
    while n:
        larger = workspace.save(_large_star(current, workspace).coalesce(few), "large-star")
        smaller = workspace.save(_small_star(larger, workspace).coalesce(few), "small-star")
        workspace.drop(current, larger)
        current = smaller
        state = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(current.select("v", "v").distinct())
