import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import QUERIES
from lexmill.llm import nearest as N


def exact(ids, x, query, k):
    s = (x * x[query]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def frame(spark, ids, x):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_full_search_is_exact_with_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    x[:120] = x[0] = [1, 2, 0, 1]  # a third of all rows is one vector
    x[(x == 0).all(axis=1)] = 1
    ids = rng.permutation(300)
    df = frame(spark, ids, x).selectExpr("*", "1 as entry", "2 as id", "3 as v", "4 as n")
    got = lists(N.nearest(df, F.col("id") % 20 == 0, visits=1000.0))
    assert set(got) == {i for i in range(300) if i % 20 == 0}
    for q, found in got.items():
        want = exact(ids, x, int(np.flatnonzero(ids == q)[0]), 20)
        assert [(v, s) for _, v, s in found] == want and [r for r, _, _ in found] == list(range(1, 21))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, -0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1.0]), (None, [9.0, 9.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (40, None), (60, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = lists(N.nearest(df, F.col("id") % 20 == 0))
    assert {q: [v for _, v, _ in f] for q, f in got.items()} == {0: [1, 20], 20: [0, 1]}
    assert N.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert N.nearest(df.where("vec_id = 1"), F.col("id") % 20 == 0).count() == 0


def test_inner_product_of_long_and_short_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.2, 3, (1500, 1))
    x = x.astype(np.float32).astype(float)
    got = lists(N.nearest(frame(spark, np.arange(1500), x), F.col("id") % 20 == 0))
    hits = sum(len({v for _, v, _ in f} & {v for v, _ in exact(np.arange(1500), x, q, 20)}) for q, f in got.items())
    assert len(got) == 75 and hits / (75 * 20) >= 0.9


def test_tiles_give_the_same_lists(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = frame(spark, np.arange(400), rng.standard_normal((400, 8)))
    whole = lists(N.nearest(df, F.col("id") % 20 == 0))
    monkeypatch.setattr(N, "TILE_VECTORS", 3)
    monkeypatch.setattr(N, "TILE_QUERIES", 2)
    assert lists(N.nearest(df, F.col("id") % 20 == 0)) == whole


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    got = lists(QUERIES["op3_nearest_neighbours"](spark, sf))
    hits = 0
    for q, found in got.items():
        want = dict(exact(ids, x, int(np.flatnonzero(ids == q)[0]), len(ids)))
        assert all(abs(want[v] - s) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(list(want)[:20]))
    assert len(got) == (ids % 20 == 0).sum() and hits / (20 * len(got)) >= 0.9
