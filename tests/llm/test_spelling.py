import random
import re
import zlib
from collections import Counter

import pytest

from lexmill.llm import QUERIES
from lexmill.llm.spelling import near_words, spelling_variants
from lexmill.llm.sql import SPELLING
from tests.oracle import compare, duck

FOLD = {c: c + 32 for c in range(65, 91)}


def counted(rows):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    """(word, form, root, n, n_near, form_n) by comparing all pairs."""
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, held in near.items():
        best = min(held, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def variants(seed, n):
    """Words around a few stems: many within one edit, many with a common half."""
    rng, letters = random.Random(seed), "abé"
    out = Counter()
    for _ in range(n):
        w = rng.choice(["abcdefg", "abcdefgh", "xbcdefghi", "éééééééé", "aaaaaaa", "prefixsuffix", "prefixsuffiy"])
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
        out[w] += rng.choice([2, 2, 20, 300])
    return {w: n for w, n in out.items() if len(w) >= 7}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("group_pairs", [100_000, 30, 0])
def test_all_pairs_within_one_edit(spark, seed, group_pairs):
    words = variants(seed, 400)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = sorted((r["a"], r["b"]) for r in near_words(df, group_pairs).collect())
    assert got == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_forms_and_roots(make_docs):
    # counts 3,000, 300, 30 and 3 along a chain: the root of the last is the first
    text = " ".join(["kitchens"] * 3000 + ["kitchenz"] * 300 + ["kitcheyz"] * 30 + ["kitchyyz"] * 3 + ["sittings", "Sittings"])
    rows = [(1, text), (2, None), (3, ""), (None, "Élèveàç élèveàç Élèveàç"), (4, "shorter"), (4, "shorter"), (5, "ab " * 20000 + "x" * 9000)]
    got = result(spelling_variants(make_docs(rows)))
    assert got == plain(counted(rows))
    roots = {r[0]: r[2] for r in got}
    assert roots["kitchyyz"] == roots["kitcheyz"] == roots["kitchenz"] == "kitchens"


def test_given_documents(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op11_spelling_variants"](spark, path)) == plain(counted(rows))


def test_odd_and_no_documents(odd_docs, make_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(spelling_variants(odd_docs)) == plain(counted(rows))
    assert spelling_variants(make_docs([])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    problems, _, _, _ = compare(QUERIES["op11_spelling_variants"](spark, path), duck(path), SPELLING)
    assert not problems, problems
