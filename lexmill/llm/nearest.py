"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample; every vector is listed in one leaf of each tree.  A query
walks all trees through one priority queue, always down the branch it misses by the least, until
it has its number of leaves.  Queries and vectors then meet leaf by leaf, in tiles of bounded
size, where candidates are scored exactly; only the best few per query and leaf travel on.

Inner products become distances on a sphere by one more component, sqrt(M^2 - |x|^2) for the
largest norm M, which is 0 for queries.  Equal vectors are one entry of the index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The forest is fitted on at most this many vectors, those with the smallest hashes of their ids.
SAMPLE = 16_384
TREES = 16
LEAVES = 128
#: Leaves a query visits, as a share of the leaves of one tree.  Vectors without any cluster
#: structure, the worst case, need about one tree's worth for a recall of 0.95.
VISITS = 1.4
#: Vectors and queries that meet in one tile.
TILE_VECTORS, TILE_QUERIES = 32_768, 8_192


class Tree:
    """Balanced tree of hyperplanes; node i has children 2i + 1 and 2i + 2, leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        self.normals = np.zeros((2**depth - 1, sample.shape[1]))
        self.offsets = np.zeros(2**depth - 1)
        groups = {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            ids = groups.pop(node)
            pair = sample[rng.choice(len(sample) if len(ids) < 2 else ids, 2, replace=len(sample) < 2)]
            normal = pair[0] - pair[1]
            if not normal.any():
                normal = rng.standard_normal(sample.shape[1])
            self.normals[node] = normal / np.linalg.norm(normal)
            side = sample[ids] @ self.normals[node]
            self.offsets[node] = np.median(side) if len(ids) else 0.0
            groups[2 * node + 1] = ids[side < self.offsets[node]]
            groups[2 * node + 2] = ids[side >= self.offsets[node]]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", x, self.normals[node]) >= self.offsets[node]
            node = 2 * node + 1 + side
        return node - (2**self.depth - 1)


def fit_forest(sample: np.ndarray, trees: int, leaves: int, seed: int) -> list[Tree]:
    """Fewer levels if the sample cannot fill the leaves with eight vectors each."""
    depth = max(0, min(int(np.log2(leaves)), int(np.log2(max(1, len(sample) // 8)))))
    return [Tree(sample, depth, np.random.default_rng([seed, t])) for t in range(trees)]


def walk(margins: np.ndarray, depth: int, visits: int) -> list[int]:
    """Leaves of all trees in the order of one priority queue; margins are (trees, nodes)."""
    inner, queue, out = 2**depth - 1, [(0.0, t, 0) for t in range(len(margins))], []
    while queue and len(out) < visits:
        missed, t, node = heapq.heappop(queue)
        while node < inner:
            m = float(margins[t, node])
            near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (max(missed, abs(m)), t, far))
            node = near
        out.append(t * (inner + 1) + node - inner)
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (id, v) with finite, non-zero vectors of the most common length."""
    v = F.col("v")
    clean = (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
        .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
        .where(F.exists(v, lambda x: x != 0))
    )
    length = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return clean.limit(0)
    return clean.where(F.size("v") == length["n"]).dropDuplicates(["id", "v"])


def _matrix(column: pd.Series, top: float | None) -> np.ndarray:
    x = np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)
    more = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0.0))
    return np.column_stack([x, more])


def _best(q: pd.DataFrame, v: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The ``keep`` best entries of a tile for every query, scores as sums in the order of components."""
    parts = []
    if len(q) and len(v):
        x, y = _matrix(v["v"], None)[:, :-1], _matrix(q["v"], None)[:, :-1]
        entry, query = v["entry"].to_numpy(), q["query"].to_numpy()
        block = max(1, (4 << 20) // len(x))
        for at in range(0, len(y), block):
            rough = y[at : at + block] @ x.T
            if keep < len(x):
                limit = np.partition(rough, len(x) - keep, axis=1)[:, len(x) - keep]
                i, j = np.nonzero(rough >= (limit - 1e-9 * np.maximum(1.0, np.abs(limit)))[:, None])
            else:
                i, j = (a.ravel() for a in np.indices(rough.shape))
            score = (y[at + i] * x[j]).sum(axis=1)
            order = np.lexsort((entry[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best = place < keep
            parts.append(pd.DataFrame({"query": query[at + i[best]], "entry": entry[j[best]], "score": score[best]}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"query": [], "entry": [], "score": []})


def nearest(
    vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, leaves: int = LEAVES, visits: float = VISITS, sample: int = SAMPLE, seed: int = 7,
) -> DataFrame:
    """query_id, rank from 1, vec_id and score for the rows where ``is_query`` (a condition on ``id``) holds.

    NULL ids, and vectors that are NULL, empty, zero, not finite or of an unusual length take no
    part.  A repeated row counts once.  Equal scores go to the smaller id, also among copies of a
    vector.  Fewer candidates give fewer rows, no rows give none; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    per_vector = Window.partitionBy("v").orderBy("id")
    # k + 1 members of every class of equal vectors are enough for any list of k
    members = materialize(
        rows.withColumn("n", F.row_number().over(per_vector)).where(F.col("n") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.element_at("ids", 1).alias("entry"), "v", "ids"),
        "entries",
    )
    asked = rows.where(is_query)
    heads = members.select("entry", "v")
    asking = materialize(
        asked.select("v").distinct().join(heads, "v").select(F.col("entry").alias("query"), "v"), "queries"
    )
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n_entries, top = heads.agg(F.count("*"), F.sqrt(F.max(norm))).first()
    n_queries = asking.count()
    out = "query bigint, entry bigint, score double"
    if not n_entries or not n_queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    picked = heads.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("v").toPandas()
    forest = spark.sparkContext.broadcast(fit_forest(_matrix(picked["v"], top), trees, leaves, seed))
    per_tree = 2 ** forest.value[0].depth
    to_visit = min(trees * per_tree, int(np.ceil(visits * per_tree)))
    # tiles: leaves are balanced on the sample, so these many parts keep each near its bound
    v_parts = 1 + n_entries // (per_tree * TILE_VECTORS)
    q_parts = 1 + n_queries * to_visit // (trees * per_tree * TILE_QUERIES)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = _matrix(part["v"], top)
            for t, tree in enumerate(forest.value):
                yield pd.DataFrame({"leaf": t * per_tree + tree.leaf(x), "entry": part["entry"], "v": part["v"]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees_ = forest.value
        for part in batches:
            x = _matrix(part["v"], None)
            margins = np.stack([x @ t.normals.T - t.offsets for t in trees_], axis=1)
            for at in range(0, len(part), 256):
                found = [walk(m, trees_[0].depth, to_visit) for m in margins[at : at + 256]]
                piece = part.iloc[at : at + 256]
                size = [len(f) for f in found]
                yield pd.DataFrame({
                    "leaf": np.concatenate(found), "query": piece["query"].repeat(size), "v": piece["v"].repeat(size),
                })

    def parts_of(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    vector_type = dict(heads.dtypes)["v"]
    listed = (
        heads.mapInPandas(place, f"leaf bigint, entry bigint, v {vector_type}")
        .withColumn("vp", F.pmod(F.xxhash64("entry"), F.lit(v_parts)).cast("int")).withColumn("qp", parts_of(q_parts))
    )
    visiting = (
        asking.repartition(max(1, spark.sparkContext.defaultParallelism), "query")
        .mapInPandas(search, f"leaf bigint, query bigint, v {vector_type}")
        .withColumn("qp", F.pmod(F.xxhash64("query"), F.lit(q_parts)).cast("int")).withColumn("vp", parts_of(v_parts))
    )
    tile = ["leaf", "vp", "qp"]
    scored = (
        visiting.groupBy(*tile).cogroup(listed.groupBy(*tile))
        .applyInPandas(lambda q, v: _best(q, v, k + 1), out)
        .groupBy("query", "entry").agg(F.max("score").alias("score"))
    )
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    best = scored.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= k + 1).drop("n")
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = materialize(
        best.join(members.select("entry", "ids"), "entry")
        .select("query", F.explode("ids").alias("vec_id"), "score")
        .withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1),
        "lists",
    )
    own = Window.partitionBy("query_id", "query").orderBy("n")
    askers = asked.join(asking, "v").select(F.col("id").alias("query_id"), "query")
    return (
        askers.join(lists, "query").where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
