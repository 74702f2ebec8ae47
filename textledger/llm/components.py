"""Connected components of an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textledger.sources.shared import stored


def at_roots(parents: DataFrame) -> DataFrame:
    """node, parent with each parent replaced by the root above it. A step doubles the way that is gone; nodes whose parent
    is a root leave, and the others look their parents up among all."""
    known, done = parents, []
    active = parents
    while not active.isEmpty():
        upper = known.select(F.col("node").alias("parent"), F.col("parent").alias("upper"))
        step = stored(active.join(upper, "parent", "left"), "steps")
        done.append(step.where("upper IS NULL").select("node", "parent"))
        active = step.where("upper IS NOT NULL").select("node", F.col("upper").alias("parent"))
        known = reduce(DataFrame.union, done, active)
    return known


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that is reachable) for each node of `edges` (a, b: long, not NULL).

    In each round every node takes its least neighbour, if that is less, as its parent; parents of parents are taken until
    all are roots, and edges are drawn anew between roots. Each component's nodes at least halve in a round and the way
    to the root in a step, so both grow as logarithms. Every step is written out.
    A node with any number of edges is a group of pre-aggregated rows and a key of joins that can be split."""
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    while not left.isEmpty():
        parents = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        parents = at_roots(stored(parents, "parents"))
        of = lambda side: parents.select(F.col("node").alias(side), F.col("parent").alias(f"{side}_parent"))
        labels = labels.join(of("component"), "component", "left")
        labels = stored(labels.select("node", F.coalesce("component_parent", "component").alias("component")), "labels")
        moved = left.join(of("a"), "a", "left").join(of("b"), "b", "left")
        a, b = F.coalesce("a_parent", "a"), F.coalesce("b_parent", "b")
        moved = moved.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b")
        left = stored(moved.distinct(), "edges")
    return labels
