"""Connected components of a table of links, by joins: links contract to a forest of depth one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def stars(pairs: np.ndarray) -> np.ndarray:
    """Pairs (n x 2) -> as few that connect the same: every other node with the smallest of its component."""
    nodes, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            other = np.flatnonzero(label != np.arange(len(nodes)))
            return np.stack([nodes[label[other]], nodes[other]], 1)
        label = new


def contracted(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(parent, node): a forest with the links' components, each node once under a smaller one.

    Each round a node keeps its smallest smaller neighbour; its other smaller neighbours are linked with that one
    instead, and a parent gives way to its own parent. Links sent by many tasks for one group fall together in the
    first rounds. Minima come from a partial aggregate and go back by a join, so no node's links meet in one group.
    """
    ends = links.select(F.least(a, b).alias("parent"), F.greatest(a, b).alias("node"))
    pairs = materialize(ends.filter("parent < node").distinct())
    while True:
        least = materialize(pairs.groupBy("node").agg(F.min("parent").alias("parent")))
        others = pairs.join(least.select("node", F.col("parent").alias("least")), "node").filter("parent <> least")
        above = least.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        forest = materialize(least.join(above, "parent", "left").select(F.coalesce("grand", "parent").alias("parent"), "node", F.col("grand").isNotNull().alias("moved")))
        spread = materialize(others.select(F.col("least").alias("parent"), F.col("parent").alias("node")).distinct())
        discard(pairs, least)
        if spread.isEmpty() and forest.filter("moved").isEmpty():
            return forest.select("parent", "node")
        pairs = materialize(forest.select("parent", "node").unionByName(spread).distinct())
        discard(forest, spread)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node of the component. One row for each node of a link.

    Rounds are few: links that come as stars need two or three, a chain of n some log n. Nothing but emptiness
    tests reaches the driver. Null ends are linked with nothing; an empty table gives no rows.
    """
    forest = contracted(links, a, b)
    roots = forest.select(F.col("parent").alias("node"), F.col("parent").alias("label")).distinct()
    return forest.select("node", F.col("parent").alias("label")).unionByName(roots)
