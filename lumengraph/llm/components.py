"""Connected components by contraction, over tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.llm import common

#: Links that one task takes at once, 16 bytes each; more are contracted by all tasks first.
FEW = 1_000_000


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b), a table in the shared folder; label: the component's least node.

    While there are more than ``few`` links, a round gives each node the one of least hash among itself and its neighbours, and
    replaces links by those between the nodes so given; hashes differ in each round, and a quarter of the nodes or more goes, on
    average, so that rounds grow as the logarithm of the nodes. What is left one task labels, and the rounds' tables lead back
    from there. Only sums and joins that Spark can split at a hot key; every round ends in a table."""
    rounds: list[DataFrame] = []
    while edges.count() > few:
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        own, to = (F.struct(F.xxhash64(F.col(c), F.lit(len(rounds))).alias("h"), F.col(c).alias("x")) for c in ("node", "to"))
        up = near.groupBy("node").agg(F.min(F.least(own, to)).alias("least")).select("node", F.col("least.x").alias("up"))
        rounds.append(up := common.write_table(up, "parents"))
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = edges.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = common.write_table(left.distinct(), "edges")
    labels = common.write_table(edges.select("a", "b").coalesce(1).mapInArrow(_label, "node long, label long"), "labels")
    for up in reversed(rounds):
        known = labels.select(F.col("node").alias("up"), "label")
        labels = common.write_table(up.join(known, "up", "left").select("node", F.coalesce("label", "up").alias("label")), "labels")
    if rounds:
        least = labels.groupBy("label").agg(F.min("node").alias("least"))
        labels = common.write_table(labels.join(least, "label").select("node", F.col("least").alias("label")), "labels")
    return labels


@common.lean
def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        node, label = least_nodes(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["node", "label"])


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, ascending, and the least node of each one's component: roots hook to the least root beside them, and
    nodes follow to the end of such a path, until all links lie within a root."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return node, node[root]
