"""Connected components over links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


#: So many distinct links, which are counted first, are joined in one task (16 bytes each there); more take the distributed rounds, with the same result.
FEW = 1 << 18


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of the links (u, v) of all batches, by hooking every root to the smaller one and shortening paths until nothing changes."""
    held = [np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))]) for b in batches if b.num_rows]
    if held:
        nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        root = np.arange(len(nodes))  # nodes are sorted, so the smallest place is the smallest node
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            for side in (root[a], root[b], a, b):
                np.minimum.at(new, side, low)
            while (shorter := new[new]).tobytes() != new.tobytes():
                new = shorter
            if new.tobytes() == root.tobytes():
                break
            root = new
        yield pa.record_batch([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def _by_node(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links (u, v) with their node's minimum m.  Both sides are stored tables, so the join can split the links of a node that has very many."""
    return links.hint("merge").join(least, "u")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (a, b: longs; direction, repeats and loops don't matter).

    Each round replaces the links of a node by links to the smallest of its
    neighbours, so the number of links doesn't grow, and components shrink to
    stars in about log(size) rounds.  Groups are reduced by their minimum, which
    combines before the shuffle and is stored before it is joined; no neighbour
    list is gathered.  Each round is written to the shared folder.
    """
    spark = links.sparkSession
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.count() <= FEW:
        parts = written(edges.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
        discard(spark, edges)
        return parts
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        # large star: every larger neighbour is linked to the node's minimum
        large = written(_by_node(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # small star: a node's smaller neighbours are linked to the smallest of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = _by_node(large, low).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "links")
        same = new.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(new, ["u", "v"], "left_anti").isEmpty()
        discard(spark, edges, least, large, low)
        edges = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
