"""Connected components: of a distributed edge list, and of a few edges inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index for each of n nodes with links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a, b).

    Each turn points every node at its least neighbour, follows the pointers ``jumps`` times,
    renames the edges' ends and drops loops, until no edge is left.  Only minima and joins are
    used, so no neighbourhood is ever gathered; every turn is written, so lost executors cost no
    more than that turn.  Direction, loops and repeated edges do not matter.
    """
    both = edges.where("a <> b").select("a", "b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    while not both.isEmpty():
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        parent = written(parent, "parents")
        for _ in range(jumps):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            parent = parent.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
        parent = written(parent, "parents")
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("component"))
        else:
            up = parent.select(F.col("node").alias("component"), F.col("parent").alias("above"))
            labels = labels.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
        labels = written(labels, "labels")
        from_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        from_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        both = both.join(from_a, "a").join(from_b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        both = written(both.distinct(), "edges")
    if labels is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
