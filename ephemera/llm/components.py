"""Distributed union-find: connected components of an edge table by min-neighbour hooking and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _jump(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Follows (node, parent), a saved table, to the roots, doubling the reach of every pointer in each pass."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        further = scratch.save(
            parents.join(above, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved"))
        )
        scratch.drop(parents)
        if further.where("moved").isEmpty():
            return further
        parents = further


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of edges(a, b) that has an edge to another node; component is its least node. A saved table.

    Each pass hooks every node onto its least smaller neighbour, which gives a forest, flattens the forest, and relabels the edges by
    its roots; edges inside one tree vanish. A star whose centre is its least node is done in one pass. All tables of a pass are written to the
    shared folder and deleted when the next one has used them, and only the question whether edges are left reaches the driver. Null ends, loops and
    repeated edges are ignored.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    left = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    known: DataFrame | None = None
    while not left.isEmpty():
        parents = _jump(scratch.save(left.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent"))), scratch)
        up = parents.select(F.col("node").alias("at"), F.col("parent").alias("root"))
        first = left.join(up.withColumnRenamed("at", "high"), "high").select(F.col("root").alias("x"), "low")
        both = first.join(up.withColumnRenamed("at", "low"), "low", "left").select("x", F.coalesce("root", "low").alias("y"))
        crossing = scratch.save(both.where("x <> y").select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct())
        if known is None:
            known = parents
        else:
            moved = known.join(up.withColumnRenamed("at", "parent"), "parent", "left").select("node", F.coalesce("root", "parent").alias("parent"))
            before, known = known, scratch.save(moved.unionByName(parents.select("node", "parent").join(known.select("node"), "node", "left_anti")))
            scratch.drop(before, parents)
        scratch.drop(left)
        left = crossing
    if known is None:
        return scratch.save(left.select(F.col("high").alias("node"), F.col("low").alias("component")))
    roots = known.select(F.col("parent").alias("node")).distinct()
    out = scratch.save(known.select("node", F.col("parent").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))))
    scratch.drop(known, left)
    return out
