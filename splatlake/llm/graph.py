"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the least node that each reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[root(x) for x in range(len(nodes))]]


def _contract(batches):
    """Links of a partition become stars: one link per node, to the least node that it reaches here."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, a)) > 2_000_000:
            nodes, roots = forest(np.concatenate(a), np.concatenate(b))
            a, b = [nodes], [roots]
    if a:
        nodes, roots = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "label"])


def components(links: DataFrame, work: Workspace, rounds: int | None = None) -> DataFrame:
    """links (a, b): long.  Returns (node, label): the least node reachable; nodes without links are not in it.

    Each round takes the least label among a node and its neighbours and then follows labels once more.  With
    ``rounds`` it may end early: equal labels still mean that two nodes are linked.
    """
    stars = work.keep(links.select("a", "b").mapInArrow(_contract, "node long, label long"))
    edges = stars.filter("node <> label")
    both = edges.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(edges.select(F.col("label").alias("u"), F.col("node").alias("v")))
    labels, n = work.keep(stars.groupBy("node").agg(F.min("label").alias("label"))), 0
    while True:
        around = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(around, labels.node == around.u, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid"))
        jump = labels.select(F.col("node").alias("k"), F.col("label").alias("far"))
        new = work.keep(step.join(jump, step.mid == jump.k, "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")))
        changed, n = new.filter("old <> label").limit(1).count(), n + 1
        labels = new.select("node", "label")
        if not changed or n == rounds:
            return labels
