"""Connected components by alternating stars, for graphs of any size and degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.workspace import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least of a vertex and its neighbours.

    ``edges`` has u > v. The large star moves a vertex's greater neighbours, the
    small star its lesser ones and itself.
    """
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u > v").distinct()


def components(edges: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """(node, component) of every node on an edge; the component is its least node.

    ``edges`` are pairs (a, b) of longs in any order; loops and repeats do no harm.
    Every step is staged, and the driver sees a count and a checksum only. A hub's
    neighbours are joined, never collected.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = workspace.stage(pairs.where("u > v").distinct(), f"{name}-0")
    seen, step = None, 0
    while True:
        mark = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == seen or not mark[0]:
            break
        seen, step = mark, step + 1
        current = workspace.stage(_star(_star(current, True), False), f"{name}-{step}")
    ends = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.union(roots)
