"""Connected components of an undirected graph, by alternating star contractions on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours of a node are linked to the smallest node around it.

    The smallest neighbour is an aggregate (combined before the shuffle) that is written out,
    so the join that follows is a plain one whose hot keys Spark can split.
    """
    sym = pairs.union(pairs.select("v", "u")).toDF("u", "v") if large else pairs
    least = materialize(sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    met = sym.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return materialize(out.where(F.col("u") > F.col("v")).distinct(), "star")


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of some rows as stars: every node but the smallest of its component, with that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, u, label[v])
        np.minimum.at(least, v, label[u])
        # a node that is no root follows its root, and roots take over what their nodes have met
        np.minimum.at(least, label, least)
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): every node of an edge with the smallest node it is connected to.

    Edges with a NULL end and loops are left out; repeats and both directions are fine; no edges
    give no rows.  Each round is written to the shared folder, so lost executors cost one round.
    """
    pairs = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(pairs)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        pairs = _star(_star(pairs, large=True), large=False)
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
