from lexmill.llm import QUERIES
from lexmill.llm.sql import URL_FILTER
from lexmill.llm.url_filter import filter_urls
from tests.oracle import compare, duck

PAGES = [
    (1, "http://a.org/x", "<p>"), (2, "https://www.Example.ORG/es/1?q#f", ""), (3, "http://example.org/en/12", None),
    (4, "http://example.org/en/2", ""), (5, "http://x.com/fr/1", ""), (6, "http://x.com/de/1", ""), (7, "http://com/de/1", ""),
    (8, "http://xcom/de/1", ""), (9, None, "<p>"), (10, "no scheme", "<p>"), (11, "http://h.net", ""), (12, "http://h.net?x", ""),
    # aliases: canonical to a blocked page, chain of refreshes to it, relative links, an allowed member
    (20, "http://n.net/a", '<link rel="canonical" href="http://x.com/de/1">'),
    (21, "http://n.net/b", "<META http-equiv=refresh content=\"0; url=/a\">"),
    (22, "http://n.net/c?utm_source=1", "<link href='b' rel='canonical'>"), (23, "https://n.net/c", ""),
    (30, "http://m.net/a", '<link rel="canonical" href="http://x.com/de/9">'),
    (31, "http://m.net/b", '<link rel="canonical" href="http://m.net/a"><link rel="canonical" href="http://a.org/z">'),
    (40, "http://k.net/a", '<link rel="stylesheet" href="http://x.com/de/1">'), (41, "http://k.net/a", ""), (41, "http://k.net/a", ""),
    (50, "http://s.net/a", '<link rel="canonical" href="http://s.net/a">'),
]
VERDICTS = {
    1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "allow",
    11: "allow", 12: "allow", 20: "block", 21: "block", 22: "block", 23: "block", 30: "allow", 31: "allow", 40: "allow",
    41: "allow", 50: "allow",
}
RULES = {1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: "org/", 5: "com/fr/", 6: "com/de/", 7: "com/de/"}


def table(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return df.selectExpr("*", "1 as key", "2 as host", "3 as path", "'z' as verdict", "4 as node", "5 as rule")


def test_verdicts(spark):
    rows = filter_urls(table(spark, PAGES)).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        assert (r["verdict"], r["rule"]) == (VERDICTS[r["page_id"]], RULES.get(r["page_id"])), r
    by_id = {r["page_id"]: r for r in rows}
    assert (by_id[2]["host"], by_id[2]["path"]) == ("www.example.org", "/es/1")
    assert (by_id[10]["host"], by_id[10]["path"]) == ("", "") and by_id[11]["path"] == ""


def test_recorded_redirects(spark):
    moved = spark.createDataFrame([("http://q.net/1", "http://q.net/2"), ("http://q.net/2", "http://x.com/de/3"), (None, "x")],
                                  "from_url string, to_url string")
    rows = filter_urls(table(spark, [(1, "http://q.net/1", ""), (2, "http://q.net/3", "")]), redirects=moved).collect()
    assert {r["page_id"]: r["verdict"] for r in rows} == {1: "block", 2: "allow"}


def test_empty_and_sql(spark, tmp_path):
    assert filter_urls(table(spark, PAGES).limit(0)).count() == 0
    spark.createDataFrame(PAGES, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/p")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/p/*.parquet')")
    assert not compare(filter_urls(spark.read.parquet(f"{tmp_path}/p")), con, URL_FILTER)[0]


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert not compare(QUERIES["op4_url_filter"](spark, sf), duck(sf), URL_FILTER)[0]
