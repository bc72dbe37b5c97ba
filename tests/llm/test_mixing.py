import math
from collections import Counter, defaultdict

import pytest

from lexmill.llm.mixing import mix, mixed_documents, sainte_lague, targets
from lexmill.llm.sql import MIXING
from lexmill.llm import QUERIES
from tests.oracle import compare, duck


def plain_targets(sizes):
    """Water-filling by the rule: share, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s == "", s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3 * sizes[s] for s in over}


def plain_seats(weights, seats):
    won = Counter()
    for _ in range(seats):
        won[max(weights, key=lambda u: (weights[u] / (2 * won[u] + 1), -u))] += 1
    return won


@pytest.mark.parametrize("weights,seats", [
    ([1.0, 1.0, 1.0], 4), ([100.0, 1.0, 1.0, 1.0], 7), ([53.0, 24.0, 23.0], 100), ([5.0] * 9, 13), ([3.0, 0.0, 8.5], 1), ([1.0], 5),
])
def test_seats_go_to_the_highest_quotients(spark, weights, seats):
    units = spark.createDataFrame([("g", i, w, i) for i, w in enumerate(weights)], "group string, unit int, weight double, place int")
    groups = spark.createDataFrame([("g", seats)], "group string, seats bigint")
    got = {r["unit"]: r["seats"] for r in sainte_lague(units, groups).collect()}
    expected = plain_seats(dict(enumerate(weights)), seats)
    assert {u: n for u, n in got.items() if n} == dict(expected)


def test_targets(spark):
    sizes = {"=a": 1000, "=b": 10, "=c": 500, "=d": 0, "": 7, "=é": 200}
    df = spark.createDataFrame(list(sizes.items()), "source_key string, source_size bigint")
    got = {r["source_key"]: r["target"] for r in targets(df).collect()}
    for s, t in plain_targets(sizes).items():
        assert math.isclose(got[s], t, abs_tol=1e-6), s


def test_mix_of_odd_documents(odd_docs):
    rows = mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    taken = defaultdict(int)
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["size"] == len((r["doc"]["text"] or "").encode().split())
        taken[r["doc"]["source"], r["target"]] += r["taken"]
    for (_, target), n in taken.items():
        assert abs(n - target) <= 32
    again = Counter((r["doc_id"], r["taken"]) for r in mix(odd_docs.repartition(5)).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in rows)


def test_taken_words_are_written(odd_docs, make_docs):
    docs = make_docs([(i, " ".join(f"{i}w{k}" for k in range(20 + i)), "en", "abc"[i % 3]) for i in range(90)])
    for df in (docs, odd_docs):
        out = mixed_documents(df)
        assert out.columns == df.columns
        written, taken = Counter(), Counter()
        for r in out.collect():
            written[r["doc_id"]] += len(r["text"].encode().split())
            assert r["n_chars"] == len(r["text"])
        for r in mix(df).collect():
            taken[r["doc_id"]] += r["taken"]
        assert +written == +taken
    per_word = Counter(w for r in mixed_documents(docs).collect() for w in r["text"].split())
    assert max(per_word.values()) <= 3


def test_hot_source_in_many_shards(make_docs):
    docs = make_docs([(i, "w " * 50, "en", "hot" if i % 3 else "cold") for i in range(300)], extra=False)
    rows = mix(docs, shard_words=500).collect()
    by_source = defaultdict(int)
    for r in rows:
        by_source[r["target"]] += r["taken"]
    for target, n in by_source.items():
        assert abs(n - target) <= 32


def test_empty_tables(make_docs):
    empty = make_docs([]).limit(0)
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0
    blank = make_docs([(1, None), (2, "")])
    assert [r["taken"] for r in mix(blank).collect()] == [0, 0]


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert not compare(QUERIES["op10_source_mix"](spark, sf), duck(sf), MIXING)[0]
