"""Connected components of a link table, with every step a join or an aggregate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import settled


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inside a task: for n places and links between them, the least place of each one's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link, and no smaller end is a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return odd.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (a, b) but for links of a node with itself: the smallest node reachable.

    Alternates two contractions: every neighbour of a node larger than it, and then
    every smaller one, is tied to the least node around. Both keep what is connected,
    so once the links are stars, the stars are the components. The rounds grow with
    the logarithm of the longest path. Minima are taken before the shuffle, and each
    table is settled, so that a hub's side of a join can be split.
    """
    both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges = settled(both.distinct(), "links")
    while not _is_forest_of_stars(edges):
        # Larger ends to the least neighbour.
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = settled(large.distinct(), "links")
        # Smaller ends, and the node itself, to the least of them.
        least = settled(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = settled(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
