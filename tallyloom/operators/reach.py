"""What can be reached along edges, with a path as witness: which held-out modules a tool's imports lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.staging import staged


def reached(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", root: str = "root") -> DataFrame:
    """(root, node, depth, path) for every node that a root leads to, itself included at depth 0.

    path is, of the shortest ones, the first in order of nodes. Each round takes one step from the nodes found last and
    keeps what was not yet found; there are as many rounds as the longest of the shortest paths, and each round's rows are
    written once. Loops, repeated edges and null ends do no harm.
    """
    steps = edges.select(F.col(src).alias("node"), F.col(dst).alias("_to")).dropna().distinct()
    front = staged(roots.select(F.col(root).alias("root")).dropna().distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path")))
    found, depth = front, 0
    while not front.isEmpty():
        depth += 1
        ways = front.join(steps, "node").groupBy("root", F.col("_to").alias("node")).agg(F.min("path").alias("path"))
        fresh = ways.join(found.select("root", "node"), ["root", "node"], "left_anti")
        front = staged(fresh.select("root", "node", F.lit(depth).alias("depth"), F.array_append("path", F.col("node")).alias("path")))
        found = found.unionByName(front)
    return found


def leaks(edges: DataFrame, roots: DataFrame, held_out: DataFrame, node: str = "node") -> DataFrame:
    """(root, node, depth, path) of the held-out nodes that a root reaches; there should be none."""
    return reached(edges, roots).join(held_out.select(F.col(node).alias("node")).distinct(), "node", "left_semi")
