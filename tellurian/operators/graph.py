"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurian.operators.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes with edges.

    ``edges`` has columns a and b.  Each round links nodes to the smallest of
    their neighbourhood (larger neighbours first, then smaller ones) and is cut
    from its lineage by a checkpoint; the number of rounds grows with the
    logarithm of the component's size.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        chained = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        forked = e.groupBy("u").count().where("count > 1")
        if chained.isEmpty() and forked.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _contracted(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, root) of one block's edges, for nodes that are not the smallest of theirs."""
    nodes, at = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low, up = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, up, low)
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return pd.DataFrame({"node": nodes[moved], "root": nodes[root[moved]]})


def block_components(edges: DataFrame, block: Callable[[Column], Column]) -> DataFrame:
    """:func:`components` of nodes that are whole numbers, where most edges stay within a ``block``.

    Each block contracts its own edges, so that rounds hold only what leads from
    block to block; a block must be small enough for one task.
    """
    placed = edges.select("a", "b", block(F.col("a")).alias("ba"), block(F.col("b")).alias("bb"))
    within = cut(placed.where("ba = bb").groupBy("ba").applyInPandas(_contracted, "node long, root long"))
    between = cut(placed.where("ba <> bb").select("a", "b"))
    met = between.select(F.col("a").alias("node")).unionByName(between.select(F.col("b").alias("node"))).distinct()
    known = cut(within.join(met, "node", "left_semi"))
    for n in ("a", "b"):
        between = between.join(known.select(F.col("node").alias(n), "root"), n, "left").withColumn(n, F.coalesce("root", n)).drop("root")
    # Edges between blocks now lead from root to root.
    far = components(between)
    near = within.join(far.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return near.select("node", F.coalesce("top", "root").alias("root")).unionByName(far)
