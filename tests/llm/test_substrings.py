import hashlib
from collections import Counter

import pytest

from lexmill.llm import QUERIES
from lexmill.llm.substrings import COVER, PERIOD, substring_dedup


def plain(texts, window):
    """Number of words, number removed and kept words of every text, by counting all windows."""
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(d), sum(gone), b" ".join(w for w, g in zip(d, gone, strict=True) if not g).decode()))
    return out


def test_cover_is_a_difference_set():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


CASES = [
    (1, words("a", 80)), (2, words("b", 13) + " " + words("a", 35)), (3, words("c", 7) + " " + words("a", 34)),
    (4, words("d", 40) + " " + words("d", 40)), (5, "same " * 50), (6, "same " * 35), (7, "same " * 34),
    (8, words("e", 36)), (9, " \n".join(words("e", 36).split())), (10, words("f", 60)), (10, words("f", 60)),
    (None, words("f", 60)), (None, words("g", 50)), (11, None), (12, ""), (13, words("h", 20000)),
    (14, "x " + words("h", 20000)[5000:9000]),
]


def collected(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect())


def expected(rows, window=35):
    return Counter((i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows], window), strict=True))


def test_passages_against_all_windows(make_docs):
    assert collected(substring_dedup(make_docs(CASES))) == expected(CASES)


def test_ids_that_are_keys(make_docs):
    rows = [(i, t) for i, (_, t) in enumerate(CASES)]
    assert collected(substring_dedup(make_docs(rows))) == expected(rows)


@pytest.mark.parametrize("window,period,cover", [(8, 7, (0, 1, 3)), (13, 13, (0, 1, 3, 9))])
def test_other_windows(make_docs, window, period, cover):
    rows = [(i, t) for i, (_, t) in enumerate(CASES) if t is None or len(t) < 1000]
    assert collected(substring_dedup(make_docs(rows), window, period, cover)) == expected(rows, window)


def test_odd_and_empty(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert collected(substring_dedup(odd_docs)) == expected(rows)
    assert substring_dedup(odd_docs.limit(0)).count() == 0


def test_query_against_all_windows(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op6_substring_dedup"](spark, sf).select(
        "doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == {
        (i, n, gone, hashlib.sha256(kept.encode()).hexdigest())
        for (i, _), (n, gone, kept) in zip(docs, plain([t for _, t in docs], 35), strict=True)
    }
