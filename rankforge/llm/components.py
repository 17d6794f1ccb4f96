"""Distributed connected components by repeated contraction.

Each round, every node points at its smallest neighbour; pointers are followed to their roots by
doubling, and edges are rewritten to join roots. Only nodes smaller than all their neighbours are left for
the next round, so chains and stars of any length are gone in a few rounds. Each round's edges and pointers
are cut off in the checkpoint folder; the driver only learns whether any are left. A root of very many nodes, or
a node of very many edges, is joined by broadcast (``join_hot``), so it never gathers in one task. Small graphs are
joined by broadcast altogether: a round over them is a few small jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import checkpoint, join_hot

#: Rows of a table that is joined by broadcast and goes on in ``_FEW`` partitions.
SMALL, _FEW = 10_000, 8


def _held(df: DataFrame) -> DataFrame:
    """``checkpoint``; jobs over hundreds of nearly empty partitions would cost more than a small table's rows."""
    made = checkpoint(df)
    return made.coalesce(_FEW) if made.count() <= SMALL else made


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``join_hot``; a small ``right`` (held) is broadcast whole, so nothing is counted or exchanged."""
    return left.join(F.broadcast(right), key) if right.count() <= SMALL else join_hot(left, right, key)


def _pointers(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that following smallest neighbours leads to."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    step = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
    step = _held(step)
    while True:
        ahead = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        moved = _joined(step, ahead, "root").select("node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved"))
        moved = _held(moved)
        step = moved.select("node", "root")
        if moved.where("_moved").isEmpty():
            return step


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``node, component``: nodes with a link, and the smallest node they reach."""
    edges = _held(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    found = None
    while not edges.isEmpty():
        step = _pointers(edges)
        if found is None:
            found = step.select("node", F.col("root").alias("component"))
        else:  # components of an earlier round that are joined now
            onward = step.select(F.col("node").alias("component"), "root")
            onward = _held(found.select("component").distinct().join(onward, "component", "left").select("component", F.coalesce("root", "component").alias("root")))
            found = _held(_joined(found, onward, "component").select("node", F.col("root").alias("component")))
        to = step.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        at = step.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        edges = _held(_joined(edges, to, "a").select("_a", "b").distinct())
        edges = _joined(edges, at, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        edges = _held(edges.where("a < b").distinct())
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return found


def joined_components(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts(node, component)`` (stored) after ``links(a, b)`` (stored) between its components or other nodes: only these links are followed again."""
    onto = _held(connected_components(links))
    if onto.isEmpty():
        return parts
    root = onto.select(F.col("node").alias("component"), F.col("component").alias("root"))
    root = _held(parts.select("component").distinct().join(root, "component", "left").select("component", F.coalesce("root", "component").alias("root")))
    moved = _joined(parts, root, "component").select("node", F.col("root").alias("component"))
    return moved.unionByName(onto.join(parts.select("node"), "node", "left_anti"))
