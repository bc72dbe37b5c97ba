import hashlib
import re
from collections import defaultdict

import pytest

from lexmill.llm import QUERIES
from lexmill.llm.line_dedup import line_dedup
from lexmill.llm.sql import LINE_DEDUP
from tests.oracle import compare, duck

UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows, min_chars=10, min_docs=2):
    """Expected (doc_id, n_lines, n_dropped, kept) by counting; rows without id are one document per text."""
    def document(i, t):
        return (i is None, i if i is not None else 0, t or "" if i is None else "")

    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(UPPER)

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(document(i, t))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [
            x for x in lines
            if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or min(holders[key(x)]) == document(i, t)
        ]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


LONG = "this line is long enough"
CASES = [
    (3, f"{LONG}\nown line number three\n{LONG}"), (1, f"  {LONG.upper()}\t\nshort\n\nshort"), (2, LONG), (2, f"{LONG}\nmore of the second"),
    (4, None), (5, ""), (6, "\n\n"), (7, f"É{LONG}"), (8, f"é{LONG}"), (9, f"\x85{LONG}"), (10, f"{LONG}\r\n"), (11, "123456789\n1234567890"),
    (12, "123456789\n1234567890"), (13, "漢字漢字漢字漢字漢字"), (14, "漢字漢字漢字漢字漢字\n"), (None, f"only here and there\n{LONG}"),
    (15, "\n".join(f"line number {i}" for i in range(20000))), (16, "line number 19999\nline number 77\nnew line at the end"),
]


@pytest.mark.parametrize("limits", [{}, {"min_docs": 3}, {"min_chars": 1}])
def test_equals_counting(make_docs, limits):
    unique = [r for n, r in enumerate(CASES) if r[0] not in [x[0] for x in CASES[:n]] and r[0] is not None]
    assert result(line_dedup(make_docs(unique), **limits)) == plain(unique, **limits)
    assert result(line_dedup(make_docs(CASES), **limits)) == plain(CASES, **limits)


def test_repeated_rows_without_ids(make_docs):
    rows = [(None, f"{LONG}\nsecond long enough line")] * 300 + [(None, "second long enough line")] * 5 + [(7, LONG)]
    got = result(line_dedup(make_docs(rows)))
    # 7 comes before rows without an id; equal rows are one document, so they share what they keep
    assert [r for r in got if r[0] == 7] == [(7, 1, 0, LONG)]
    assert len(got) == 306 and len(set(got)) == 3
    assert all(LONG not in r[3] for r in got if r[0] is None)
    assert sum("second" in r[3] for r in got) in (300, 5)


def test_odd_and_no_documents(odd_docs, make_docs):
    assert line_dedup(odd_docs).count() == odd_docs.count()
    assert line_dedup(make_docs([])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    problems, _, _, _ = compare(QUERIES["op12_line_dedup"](spark, path), duck(path), LINE_DEDUP)
    assert not problems, problems


def test_plain_columns_only(spark):
    df = line_dedup(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    first = df.orderBy("doc_id").first()
    assert hashlib.sha256(first["kept_text"].encode()).hexdigest()
