"""Connected components of a link table, by alternating star contractions (a distributed union-find)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FEW = 250_000  # links that one task unites at once, 4 MB; with more of them rounds over the whole cluster are taken


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the trees of i and j in an array of labels, in rounds over all pairs at once; labels are smallest members."""
    while True:
        a, b = label[i], label[j]
        if not (differ := a != b).any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def few_components(batches):
    """(node, component) of the links (a, b) of one partition."""
    import pyarrow as pa

    parts = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches]
    if parts:
        nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        i, j = at.reshape(2, -1)
        label = np.arange(len(nodes))
        united(label, i, j)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that is reachable, for every node with a link.

    Each round ties every node's larger neighbours, then its smaller ones, to the smallest node in sight. Links only
    ever move to smaller nodes, their number doesn't grow, and the rounds needed grow with the logarithm of the longest
    path. Only sums over the links reach the driver. Each round is written to the shared folder; hubs are aggregated
    map-side and joined by plain equi-joins, which adaptive execution splits. FEW links or less are united in one task.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges, before, step = scratch.save(edges, f"{name}-0"), None, 0
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        if mark[0] <= FEW:
            return edges.repartition(1).mapInArrow(few_components, "node long, component long")
        before, step = mark, step + 1
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = scratch.save(large.distinct(), f"{name}-{step}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.save(small.union(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-large")
    # A star forest is left: each node hangs on its component's smallest one.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )
