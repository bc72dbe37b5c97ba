import hashlib
import re

from lexmill.llm import QUERIES
from lexmill.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = [int(c) for c in d][::-1]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def plain_spans(text):
    """The patterns as they are written down, searched from left to right."""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for k, (pattern, ok) in enumerate([
        (EMAIL, lambda s: True), (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        (CARD, lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))), (PHONE, lambda s: 9 <= len(digits(s)) <= 15),
    ]):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if ok(m.group())]
    return sorted(out)


TRICKY = [
    "a@b.co", "x@y", "a@b@c.de", "a@b.c.d-e.f, x", "..a%+-@b.c-", "@b.co", "a@@b.co", "é@b.co a@é.co", "a@b..co", "a@b.co@c.de.f",
    "a.b@c.d.e@f.g", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.0003.4", "1.2.3", "12345678901.2.3.4", "1..2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111", "1 2 3", "4111111111111111 4111111111111111",
    "+1 (706) 555-3138", "+1", "+12", "+123456789", "+1234567890123456", "++1 23 45 67 89", "+1 2 3 4 5 6 7 8 9 ( x", "😀 +49 30 1234567 a@b.co",
    "", None, "9" * 3000, "a" * 3000 + "@b.co", "1." * 2000,
]


def test_base_spans_are_those_of_the_patterns():
    for text in TRICKY:
        assert [(s, k, e) for s, k, e, _ in P.base_spans(text)] == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 2_000_000, "9" * 2_000_000, "a.b-" * 300_000, "1." * 700_000, "+" * 500_000):
        P.base_spans(text)


def test_revealing_terms(make_docs):
    # 'quokka' stands near one address in different surroundings and nowhere else; 'zebra' stands everywhere
    rows = [(i, f"start{i} zebra Quokka jo@x.org zebra more{i}.") for i in range(4)]
    rows += [(10 + i, f"zebra other{i} text") for i in range(40)]
    rows += [(60 + i, "copied secretword kim@x.org copied") for i in range(9)]
    # 'half' is near the address in 3 of 5 texts
    rows += [(80 + i, f"uuu{i} half bo@x.org vvv{i}") for i in range(3)] + [(90, "half one"), (91, "two half")]
    got = {r["doc_id"]: [(s["low"], s["kind"], s["high"]) for s in r["spans"]] for r in P.private_report(make_docs(rows)).collect()}
    first = rows[0][1]
    assert got[0] == [(first.index("Quokka"), 5, first.index("Quokka") + 6), (first.index("jo@"), 0, first.index("jo@") + 8)]
    assert got[10] == []
    assert [k for _, k, _ in got[60]] == [0]  # equal surroundings count once
    assert [k for _, k, _ in got[80]] == [4, 0] and got[90] == []
    texts = {r["doc_id"]: r["text"] for r in P.sanitised(make_docs(rows)).collect()}
    assert texts[0] == "start0 zebra  [EMAIL] zebra more0."
    assert texts[80] == "uuu0 [TERM] [EMAIL] vvv0" and texts[90] == "half one"


def test_revealing_terms_go_from_whole_texts(make_docs):
    far = [" ".join(f"far{n}x{i}" for i in range(20)) for n in range(40)]
    rows = [(i, f"aa{i} Quokka jo@x.org bb{i} {far[i]} (Quokka) quokka@z.org") for i in range(9)] + [(9, f"Then Quokka. {far[9]}")]
    # 'half' is near the address in 3 of 5 texts: it is generalised where the address is, near or far
    rows += [(20 + i, f"uu{i} half bo@x.org vv{i} {far[20 + i]} Half") for i in range(3)]
    rows += [(30, "half one"), (31, f"half {far[31]} bo@x.org")]
    texts = {r["doc_id"]: r["text"] for r in P.sanitised(make_docs(rows)).collect()}
    assert texts[0] == f"aa0  [EMAIL] bb0 {far[0]}  [EMAIL]"
    assert texts[9] == f"Then  {far[9]}"
    assert texts[20] == f"uu0 [TERM] [EMAIL] vv0 {far[20]} [NAME]"
    assert texts[30] == "half one" and texts[31] == f"[TERM] {far[31]} [EMAIL]"
    spans = {r["doc_id"]: [(s["low"], s["kind"], s["high"]) for s in r["spans"]] for r in P.private_report(make_docs(rows)).collect()}
    assert spans[9] == [(5, 5, 12)]


def test_odd_documents(odd_docs):
    rows = P.private_report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    clean = P.sanitised(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    assert {r["text"] for r in clean.where("doc_id = 9").collect()} == {"The mail is [EMAIL] and [IP]."}
    assert clean.where("text is null").count() == 1
    assert clean.where("n_chars <> length(text)").count() == 0
    assert P.private_report(odd_docs.limit(0)).count() == 0 and P.sanitised(odd_docs.limit(0)).count() == 0


def test_overlapping_spans_become_one():
    spans = [{"low": 2, "kind": 3, "high": 8}, {"low": 3, "kind": 2, "high": 10}, {"low": 11, "kind": 5, "high": 12}]
    assert P.rewrite("a 12345678b c", spans) == "a [PHONE]bc"


def test_query_against_the_patterns(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = ["email", "ip", "card", "phone"]
    for r in QUERIES["op7_private_terms"](spark, sf).collect():
        spans = plain_spans(docs[r["doc_id"]])
        listed = [f"{names[k]}:{s}:{e}" for s, k, e in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(listed) <= set(r["spans"].split(","))  | {""}
