"""The stages against brute force, and near-duplicates on their own."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pandas as pd
from lexmill.llm import near_duplicates as N
from lexmill.llm.common import materialize, table
from lexmill.llm.pii import base_spans

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, k, rng):
    w = text.split()
    for i in rng.sample(range(len(w)), k):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def test_near_copies_go_and_others_stay(make_docs):
    rng = random.Random(4)
    rows, i = [], 0
    families = {}
    for f in range(25):
        base = " ".join(f"{f}word{rng.randrange(10**6)}" for _ in range(300))
        for k in (0, 0, 3, 5, 40):  # exact copy, Jaccard about 0.9 and 0.84, and far below 0.8
            rows.append((i, edited(base, k, rng) if k else base))
            families.setdefault(f, []).append(i)
            i += 1
    rows += [(1000, None), (1001, ""), (1002, "short"), (1003, "Short"), (1004, "other")]
    stay = {r["doc_id"] for r in N.without_near_duplicates(make_docs(rows)).collect()}
    for ids in families.values():
        assert stay & set(ids) == {ids[0], ids[4]}
    assert {1000, 1002, 1004} <= stay and not {1001, 1003} & stay


def test_a_large_group_in_tiles(make_docs, monkeypatch):
    monkeypatch.setattr(N, "candidates", lambda nodes, f=N.candidates: f(nodes, tile=8))
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    rows = [(i, edited(base, 3, rng)) for i in range(60)] + [(100, "something else entirely here now")]
    assert {r["doc_id"] for r in N.without_near_duplicates(make_docs(rows)).collect()} == {0, 100}


def test_only_pairs_at_the_similarity_are_linked(make_docs):
    # templates that share most of their shingles, then pairs at 0.8 and just below it
    rng = random.Random(6)
    fresh = lambda k: [f"v{rng.randrange(10**9)}" for _ in range(k)]
    shared = fresh(304)
    rows = [(i, " ".join(shared + fresh(52))) for i in range(1000)]  # 300 of 352 shingles: 0.743
    rows += [(2000 + i, " ".join(shared + fresh(37))) for i in range(2)]  # 300 of 337 each: 0.802
    kept = {r["doc_id"] for r in N.without_near_duplicates(make_docs(rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert 0.74 < jaccard(sets[0], sets[1]) < 0.75 and 0.8 <= jaccard(sets[2000], sets[2001]) < 0.81
    assert kept == {*range(1000), 2000}
    a, b, c = fresh(40), fresh(5), fresh(5)
    pair = [(1, " ".join(a + b)), (2, " ".join(a + c))]  # 36 of 46 shingles
    exact = [(3, " ".join((x := fresh(84)) + fresh(10))), (4, " ".join([*x, *fresh(10)]))]  # 80 of 100: 0.8
    assert jaccard(shingles(exact[0][1]), shingles(exact[1][1])) == 0.8
    assert {r["doc_id"] for r in N.without_near_duplicates(make_docs(pair + exact)).collect()} == {1, 2, 3}


def test_related_texts_do_not_displace_a_link(make_docs):
    rng = random.Random(7)
    fresh = lambda k: [f"v{rng.randrange(10**9)}" for _ in range(k)]
    shared = fresh(304)
    rows = [(i, " ".join(shared + fresh(60))) for i in range(500)]  # 300 of 360 shingles: 0.714
    for i in range(20):
        mine = fresh(26)  # 326 of 360 with its copy: 0.83
        rows += [(1000 + i, " ".join(shared + mine + fresh(34))), (2000 + i, " ".join(shared + mine + fresh(34)))]
    assert 0.82 < jaccard(shingles(rows[-1][1]), shingles(rows[-2][1])) < 0.84
    kept = {r["doc_id"] for r in N.without_near_duplicates(make_docs(rows)).collect()}
    assert kept == {*range(500), *range(1000, 1020)}


def test_lists_tally_shared_bytes():
    # rows 0 and 1 differ in one bit of every byte, few bits and no shared byte; rows 2 and 3 share four bytes and nothing else
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 256, (4, 8 * N.HEAD_WORDS), dtype=np.uint8)
    raw[1] = raw[0] ^ 1
    raw[3] = ~raw[2]
    raw[3, :4] = raw[2, :4]
    heads = dict(zip(N.HEADS, np.ascontiguousarray(raw).view(np.int64).T, strict=True))
    for copies in (1, N.LONG):  # a short list, and one above LONG rows with rows that are near to nothing
        far = rng.integers(0, 2**63, (copies - 1, N.HEAD_WORDS))
        block = pd.DataFrame({"key": 7, "node": np.arange(3 + copies), **{w: np.append(h, far[:, i]) for i, (w, h) in enumerate(heads.items())}})
        assert N.list_links(block, 4)[["a", "b"]].to_numpy().tolist() in ([[2, 3]], [[3, 2]])
        assert not len(N.list_links(block, 5))


def test_every_byte_is_in_the_index(spark):
    row = bytearray(range(256))
    nodes = spark.createDataFrame([(1, row)], "node bigint, sketch binary")
    lists = N.index_lists(nodes).collect()
    assert sorted(b for r in lists for b in ((r["key"] & 255), (r["key"] >> 8) & 255)) == list(range(256))
    for r in lists:
        tallied = b"".join(r[w].to_bytes(8, "little", signed=True) for w in N.HEADS)
        assert r["key"] & 255 not in tallied and len(set(tallied)) == 8 * N.HEAD_WORDS


def test_short_texts_are_decided_on_their_shingles():
    # 4 of 5 shingles are shared: 0.8, but bits of so few shingles agree less often than those of long texts
    rng = np.random.default_rng(3)
    steps = np.arange(1, N.FINGERPRINT_WORDS, dtype=np.uint64) * N._GOLDEN
    for _ in range(100):
        long = np.sort(rng.integers(0, 2**63, 5, dtype=np.uint64))
        sets = [long, long[1:]]
        sketch = np.stack([N.majority(np.column_stack([h, N.mix(h[:, None] + steps)])) for h in sets])
        assert N.exact_forest(sketch, sets, None, 0.8) == [(0, 1)]


def test_only_texts_of_clusters_are_joined(spark):
    texts = spark.range(-2000, 2000).selectExpr("id as _rid", "cast(0 as int) as _tag", "cast(id as string) as text")
    kept = {r["_rid"] for r in N.meeting(texts, texts.where("_rid % 100 = 0")).collect()}
    assert {i for i in range(-2000, 2000) if i % 100 == 0} <= kept and len(kept) < 50


def test_forests_are_cheapest():
    rng = np.random.default_rng(0)
    heads = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    heads[20:] = heads[:20] ^ (np.uint64(1) << rng.integers(0, 64, (20, 2), dtype=np.uint64))
    pairs = {(a, b): int(N.differing(heads[a], heads[b])) for a, b in combinations(range(40), 2)}
    close = [p for p in sorted(pairs, key=pairs.get) if pairs[p] <= 60]
    keep = N.cheapest_forest(*(np.array(x) for x in zip(*close, strict=True)), np.array([pairs[p] for p in close]))
    cost = sum(pairs[close[i]] for i in keep)
    tree = N.prim(heads, 60)
    assert len(tree) == len(keep) and sum(pairs[min(a, b), max(a, b)] for a, b in tree) == cost


def test_near_duplicates_of_odd_documents(odd_docs):
    kept = N.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert N.without_near_duplicates(odd_docs.limit(0)).count() == 0


def test_stages_on_the_tables(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dedup", "pii", "source_mix", "packing"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), f"test-{name}")
        kept[name] = out.collect()
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        docs = out
    source = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    stay = {r["doc_id"] for r in kept["quality_classifier"]}
    assert all(i in stay for i, q in labels.items() if q == 1) and any(i not in stay for i, q in labels.items() if q == 0)
    single = {r["doc_id"] for r in kept["near_dedup"]}
    sets = {i: shingles(source[i]) for i in stay}
    for i in stay - single:
        assert any(jaccard(sets[i], sets[j]) >= 0.7 for j in stay if j < i)
    assert not [(i, j) for i, j in combinations(sorted(single), 2) if jaccard(sets[i], sets[j]) >= 0.85]
    assert {r["doc_id"] for r in kept["pii"]} == single
    assert not [r for r in kept["pii"] if base_spans(r["text"])]
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in kept["pii"]}
    mixed: dict = {}
    for r in kept["source_mix"]:
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert all(n <= 3 * size[i] for i, n in mixed.items()) and abs(sum(mixed.values()) - sum(size.values())) <= 32
    packed: dict = {}
    for r in kept["packing"]:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["n_words"]
        assert len(r["text"].encode().split()) == r["n_words"]
    assert packed == mixed


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
