"""From links found inside small blocks to links per document and connected components.

A block reports, per member, how many vectors or documents it is linked with in that block, and one edge to the smallest
member of its local component.  Pairs never leave the block, so a dense group of n members costs n rows per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
FOUND_TYPE = "a long, b long, n long"


def local_links(near: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, other: np.ndarray | None = None, other_sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a, b, n`` for every linked member: itself, the smallest node of its local component, how many it is linked with.

    ``near`` is a symmetric matrix without diagonal over ``nodes``, or a matrix of ``nodes`` by ``other``.
    """
    if other is None:
        counts = near @ sizes
        label = nodes.copy()
        while True:
            best = np.minimum(label, np.where(near, label, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
            if (best == label).all():
                break
            label = best
        hit = counts > 0
        return nodes[hit], label[hit], counts[hit]
    left, right = near @ other_sizes, near.T @ sizes
    a, b = nodes.copy(), other.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(near, b, top).min(axis=1, initial=top))
        new_b = np.minimum(b, np.where(near.T, new_a, top).min(axis=1, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    hit, hit_other = left > 0, right > 0
    return (np.concatenate([nodes[hit], other[hit_other]]), np.concatenate([a[hit], b[hit_other]]), np.concatenate([left[hit], right[hit_other]]))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is its smallest node.

    Large and small stars in turn (Kiveris et al., "Connected components in MapReduce and beyond"): the number of rounds
    grows with the logarithm of the longest chain, not with its length.  Each round is written to the shared folder.  A hub
    is pre-aggregated by its minimum; the join that spreads the minimum has one row per key on one side, so adaptive
    execution splits the hub's rows.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        lows = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lows, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # After the large star the first node of an edge is the greater one.
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        spread = large.join(lows, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(spread.select("e.a", "e.b").where("a <> b").distinct(), name)
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def summary(found: DataFrame, name: str) -> DataFrame:
    """``node, links, component`` of every linked node from the rows of all blocks, which are written once."""
    found = stored(found, name)
    links = found.groupBy("a").agg(F.sum("n").alias("links"))
    joined = links.select(F.col("a").alias("node"), "links").join(components(found.select("a", "b"), name), "node", "left")
    return joined.select("node", "links", F.coalesce("component", "node").alias("component"))
