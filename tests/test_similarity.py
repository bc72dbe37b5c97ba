"""The set-similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions.joins import salted_join
from lexmill.operators import similarity


def plain(rows, t):
    sets = {i: frozenset(toks or []) for i, toks in rows}
    classes = {}
    for i in sorted(sets):
        classes.setdefault(sets[i], []).append(i)
    reps = [(ids[0], s) for s, ids in classes.items() if s]
    pairs = {}
    for i, (a, x) in enumerate(reps):
        for b, y in reps[i + 1:]:
            j = len(x & y) / len(x | y)
            if j >= t - 1e-9:
                pairs[min(a, b), max(a, b)] = j
    members = []
    for i, s in sets.items():
        ids = classes[s]
        mine = [j for p, j in pairs.items() if ids[0] in p]
        members.append((i, ids[0], len(ids), len(mine), max(mine) if mine else None))
    return pairs, sorted(members)


def run(spark, rows, t, part_rows=2000):
    df = spark.createDataFrame(rows, "id BIGINT, toks ARRAY<STRING>")
    pairs, members = similarity.similarity_classes(df, "id", F.col("toks"), t, part_rows)
    got = {(r["class_a"], r["class_b"]): r["jaccard"] for r in pairs.collect()}
    return got, sorted((r["id"], r["class_id"], r["members"], r["links"], r["best_jaccard"]) for r in members.collect())


def near_sets(seed, n):
    """Sets around a few centres, with copies, empty and NULL sets and one token that all hold."""
    rng = random.Random(seed)
    centres = [[f"c{c}w{i}" for i in range(rng.choice([3, 8, 20]))] for c in range(6)]
    rows = [(10_000, None), (10_001, []), (10_002, ["the"]), (10_003, ["the"])]
    for i in range(n):
        toks = [w for w in rng.choice(centres) if rng.random() < 0.8] + ["the", f"n{rng.randrange(40)}"] * rng.randrange(3)
        rows.append((i, toks))
    return rows


@pytest.mark.parametrize("t,part_rows", [(0.5, 2000), (0.5, 7), (0.8, 7), (1.0, 2000), (0.3, 50)])
def test_equals_all_pairs(spark, t, part_rows):
    rows = near_sets(int(10 * t), 150)
    pairs, members = plain(rows, t)
    got, got_members = run(spark, rows, t, part_rows)
    assert got.keys() == pairs.keys() and all(abs(got[p] - pairs[p]) < 1e-12 for p in pairs)
    assert [m[:4] for m in got_members] == [m[:4] for m in members]
    assert [m[4] for m in got_members] == pytest.approx([m[4] for m in members])


def test_copies_are_counted_not_paired(spark):
    rows = [(i, ["a", "b", "c", "d"]) for i in range(3000)] + [(5000, ["a", "b", "c", "e"])]
    got, members = run(spark, rows, 0.5)
    assert got == {(0, 5000): 0.6}
    assert all(m == (m[0], 0, 3000, 1, 0.6) for m in members[:-1]) and members[-1] == (5000, 5000, 1, 1, 0.6)


def test_without_rows(spark):
    assert run(spark, [], 0.5) == ({}, [])


def test_copies_of_a_large_small_side_are_not_broadcast(spark, tmp_path):
    """The estimate of a file knows nothing of its copies per salt, which the driver would hold."""
    spark.range(100_000).select(F.xxhash64("id").alias("token"), F.col("id").alias("df")).write.parquet(str(tmp_path / "s"))
    small = spark.read.parquet(str(tmp_path / "s"))
    big = spark.range(10).select(F.xxhash64("id").alias("token"), "id")
    joined = salted_join(big, small, ["token"], "id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 10
    few = salted_join(big, small.limit(1), ["token"], "id")
    assert few.count() <= 10


def test_pairs_that_share_little_are_not_kept(spark, monkeypatch):
    """Texts that meet on a rare word but share little else are told apart where they meet; nothing is moved for them."""
    rng = random.Random(4)
    rows = [(i, [f"w{k}" for k in rng.sample(range(8000), 60)]) for i in range(400)]
    rows.append((1000, rows[0][1] + ["more"]))
    kept, write = [], similarity.materialize

    def counted(df, label, **options):
        out = write(df, label, **options)
        if label == "pairs":
            kept.extend(b for r in out.collect() for b in (r["b"] if isinstance(r["b"], list) else [r["b"]]))
        return out

    monkeypatch.setattr(similarity, "materialize", counted)
    got, _ = run(spark, rows, 0.5)
    assert got.keys() == plain(rows, 0.5)[0].keys() == {(0, 1000)}
    # lengths, places and shared words of the prefixes alone leave 4,480
    assert 0 < len(kept) < 1000
