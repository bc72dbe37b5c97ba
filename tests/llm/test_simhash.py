import itertools
import random

import numpy as np
import pytest
import xxhash

from lexmill.llm import simhash as S
from lexmill.llm.components import components
from lexmill.llm import QUERIES


def plain_fingerprint(text, width=4):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, max_bits):
    """Index of the group of every fingerprint, by comparing all pairs."""
    group = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= max_bits and group[i] != group[j]:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    return group


def test_position_sets_cover_every_four_positions():
    sets = S.position_sets(4)
    assert len(sets) == 20
    for four in itertools.combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in sets)


def test_majority_counts_bits():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 7, 50):
        rows = rng.integers(0, 2**63, (n, 3), dtype=np.uint64)
        bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(axis=0)
        expected = np.packbits(2 * bits > n, bitorder="little").view(np.uint64)
        assert (S.majority(rows) == expected).all()


def near_prints(seed, centres=6, each=40):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("tile", [16, 16384])
def test_links_have_the_components_of_all_pairs(spark, tile):
    prints = near_prints(3)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    found = {r["node"]: r["root"] for r in components(S.links(fps, 4, tile=tile), "a", "b").collect()}
    expected = plain_groups(prints, 4)
    got = [found.get(x, x) for x in signed]
    for i, j in itertools.combinations(range(len(prints)), 2):
        assert (expected[i] == expected[j]) == (got[i] == got[j])


def test_groups_of_odd_documents(odd_docs):
    rows = S.simhash_groups(odd_docs).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    by_print = {}
    for r in texts:
        by_print.setdefault(plain_fingerprint(r["text"]), []).append(r["doc_id"])
    prints = list(by_print)
    groups = plain_groups(prints, 4)
    least = {}
    for p, g in zip(prints, groups, strict=True):
        least.setdefault(g, []).extend(i for i in by_print[p] if i is not None)
    expected = {p: min(least[g], default=None) for p, g in zip(prints, groups, strict=True)}
    for r in rows:
        assert expected[r["fp"] % (1 << 64)] == r["component_id"]


def test_empty_table(spark, make_docs):
    assert S.simhash_groups(make_docs([]).limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 200)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (300, 300), (2, 1), (None, 4), (400, 401)], "a int, b int")
    found = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    assert {found[i] for i in range(1, 41)} == {1}
    assert {found[i] for i in range(100, 200)} == {100}
    assert found[401] == 400 and 300 not in found
    assert components(edges.limit(0), "a", "b").count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op5_simhash_groups"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    ids = sorted(prints)
    groups = dict(zip(ids, plain_groups([prints[i] for i in ids], 4), strict=True))
    least = {}
    for i in ids:
        least.setdefault(groups[i], i)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {
        (i, f"{prints[i]:016x}", least[groups[i]]) for i in ids
    }
