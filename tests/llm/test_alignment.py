import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import QUERIES
from lexmill.llm.alignment import FIRST, SECOND, TOKENIZERS, Fragment, align_tokens, fragment, load

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def pair():
    return load(TOKENIZERS, FIRST, SECOND)


def groups_of(pair, text):
    """Groups of a whole text, tokenized at once; None if a tokenizer does not give its bytes back."""
    ((a, b, same),) = pair.tokens([text])
    if not same:
        return None
    ends = []
    for ids, known in ((a, pair.bytes_a), (b, pair.bytes_b)):
        at, out = 0, []
        for i in ids:
            at += len(known[i])
            out.append(at)
        ends.append(out)
    common = sorted(set(ends[0]) & set(ends[1]))
    sides = []
    for ids, es in zip((a, b), ends):
        held = defaultdict(list)
        for i, e in zip(ids, es):
            held[bisect_left(common, e)].append(i)
        sides.append(held)
    return [(sides[0][k], sides[1][k]) for k in range(len(common))]


def plain(pair, rows):
    docs = [(i, groups_of(pair, t) if t else None) for i, t in rows]
    links = [[(x, y) for a, b in g or [] for x in a for y in b] for _, g in docs]
    count = Counter(p for held in links for p in set(held))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (i, g), held in zip(docs, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((
            i, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(held),
            sum(count[p] == top[p[0]] for p in held), sum(count[p] for p in held),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


MIXED = "Größe 漢字かな 😀 emoji <|endoftext|> <s> naïve  two   spaces\n\nnew\tline\r\n'quoted' don't a.b.c 12345 ﬁ x́ "
CASES = [
    (1, "plain words here"), (2, MIXED), (2, MIXED), (3, MIXED * 40), (4, "x" * 3000), (5, "漢字" * 800), (6, ""), (7, None),
    (8, " "), (9, "  leading and trailing  "), (None, "no id at all " * 60), (None, None), (10, "\x00 nul \x01"), (11, "▁ real ▁mark"),
    (12, "word\n" * 500), (13, "ab " * 700), (14, "<0x41> <unk> " * 30), (15, "a b 　c  d"), (16, "\n"),
]


@pytest.mark.parametrize("sizes", [{}, {"piece": 400, "size": 96}, {"piece": 64, "size": 20}])
def test_equals_whole_texts(pair, make_docs, sizes):
    assert result(align_tokens(make_docs(CASES), **sizes)) == sorted(plain(pair, CASES), key=str)


def test_given_documents(pair, spark):
    got = QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert result(got) == sorted(plain(pair, rows), key=str)


def test_odd_and_no_documents(pair, odd_docs, make_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(align_tokens(odd_docs)) == sorted(plain(pair, rows), key=str)
    assert align_tokens(make_docs([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=30), st.data())
def test_composition_is_associative(a, b, data):
    """Any cut of the bytes and any order of composing gives the groups of the whole."""
    total = max(sum(a), sum(b))
    streams = []
    for n, lengths in ((0, [*a, total - sum(a)]), (100, [*b, total - sum(b)])):
        at, out = 0, []
        for i, length in enumerate(x for x in lengths if x):
            at += length
            out.append((n + i % 7, at))
        streams.append(out)
    cuts = sorted({0, total, *data.draw(st.lists(st.integers(0, total), max_size=6))})
    held = [
        fragment(*[[t for t in s if low < t[1] <= high] for s in streams]) for low, high in zip(cuts, cuts[1:])
    ] or [Fragment()]
    while len(held) > 1:
        i = data.draw(st.integers(0, len(held) - 2))
        held[i : i + 2] = [held[i] + held[i + 1]]
    assert held[0].finished() == fragment(*streams).finished()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,'\n1é漢▁-", min_size=1, max_size=60))
def test_parts_are_tokenized_like_the_whole(text):
    p = load(TOKENIZERS, FIRST, SECOND)
    whole = groups_of(p, text)
    parts = [groups_of(p, part) for part in p.parts(text)]
    assert (None if None in parts else [g for part in parts for g in part]) == whole
