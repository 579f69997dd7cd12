"""Depth-bounded closure over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.settle import settle


def bounded_closure(edges: DataFrame, seeds: DataFrame, depth: int, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """(node, depth) of all nodes within ``depth`` steps of the seeds, each at its least depth.

    A frontier loop: one join a level, and a visited set that keeps cycles and diamonds from repeating.
    Each level is written to the session's shared folder, so lineage stays short; the loop ends early
    where a level reaches nothing new, so a large ``depth`` gives the whole closure. Nulls are no nodes.
    """
    e = settle(edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst")).where("_src IS NOT NULL AND _dst IS NOT NULL").distinct())
    visited = settle(seeds.select(F.col(node)).where(F.col(node).isNotNull()).distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for level in range(1, depth + 1):
        reached = frontier.join(e, frontier[node] == e["_src"]).select(F.col("_dst").alias(node)).distinct()
        frontier = settle(reached.join(visited, node, "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited
