"""Connected components by repeated contraction to the smallest neighbour.

Every round hooks each node to the smallest label among itself and its
neighbours and renames the edges; edges inside a label vanish.  Labels are a
bijective bit mix of the ids, so chains of ascending ids shrink geometrically.
All state lives in tables written to the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, written


def mixed(x: Column) -> Column:
    """A bijection of 64-bit integers (xorshift steps 13, 7, 17)."""
    for left, by in ((True, 13), (False, 7), (True, 17)):
        x = x.bitwiseXOR(F.shiftleft(x, by) if left else F.shiftrightunsigned(x, by))
    return x


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges``: long columns a, b (loops and repeats are fine).  Returns node, root: one row per node that has an edge.

    ``root`` is the same for nodes that are connected, and says nothing else.
    """
    pairs = written(edges.filter("a <> b").select("a", "b").distinct(), f"{label}-edges")
    names = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # round 0 goes from ids to labels
    hooks = names.groupBy(F.col("a").alias("node")).agg(F.min(mixed(F.col("b"))).alias("least"))
    found = written(hooks.select("node", F.least(mixed(F.col("node")), F.col("least")).alias("root")), f"{label}-map")
    left = _renamed(pairs, found, label)
    discard(pairs)
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), f"{label}-map")
        moved = found.join(hooks.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        following = written(moved, f"{label}-map")
        renamed = _renamed(left, hooks, label)
        for old in (found, left, hooks):
            discard(old)
        found, left = following, renamed
    discard(left)
    return found


def _renamed(edges: DataFrame, hooks: DataFrame, label: str) -> DataFrame:
    """The edges between the labels of their ends."""
    moved = edges.join(hooks.toDF("a", "u"), "a").select("u", "b").join(hooks.toDF("b", "v"), "b").filter("u <> v")
    return written(moved.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), f"{label}-edges")


def smallest_members(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """``nodes``: node, first (the smallest id a node stands for).  Returns node, component: the smallest id reachable."""
    found = components(edges, label)
    least = written(nodes.join(found, "node").groupBy("root").agg(F.min("first").alias("component")), f"{label}-least")
    by_node = found.join(least, "root").select("node", "component")
    return written(nodes.join(by_node, "node", "left").select("node", F.coalesce("component", "first").alias("component")), label)
