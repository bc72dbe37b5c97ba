"""Provider records: the match ladder against brute force, children, reviews and flat rows of odd records."""

import random
import re
from datetime import date

from lexmill.operators import ingest


def slug(name):
    bare = re.sub(r"\s*\(([0-9]{4})\)\s*$", "", name).strip().lower()
    return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", bare))


def ladder(query, hint, records):
    """Exact slugs, else slugs that begin with the query's, else the first; the hinted year, then the date, then the place."""
    for tier, fits in ((1, lambda s: s == slug(query)), (2, lambda s: s.startswith(slug(query)))):
        pool = [r for r in records if r[1] is not None and fits(slug(r[1]))]
        if pool:
            return min(pool, key=lambda r: (not (r[2] and r[2].year == hint), r[2] or date(9999, 12, 31), r[3]))[0], tier
    return min(records, key=lambda r: r[3])[0], 3


def test_match_ladder_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["Far", "Cry", "5", "far", "Cry!", "Gold", "(2018)", "Über"]
    records = [
        (i, None if i % 37 == 0 else " ".join(rng.choices(words, k=rng.randrange(1, 5))),
         None if i % 5 == 0 else date(rng.randrange(2015, 2019), rng.randrange(1, 13), 1), i, rng.choice("ab"))
        for i in range(300)
    ]
    queries = [(" ".join(rng.choices(words, k=rng.randrange(1, 4))) + " " * i, rng.choice(["a", "b"]), rng.choice([2016, 2018, None])) for i in range(60)]
    queries += [("", "a", 2016), ("!!", "b", None)]
    r = spark.createDataFrame(records, "record_id BIGINT, name STRING, released DATE, pos BIGINT, list STRING")
    q = spark.createDataFrame(queries, "query STRING, list STRING, year_hint INT")
    got = {x["query"]: (x["record_id"], x["tier"]) for x in ingest.best_match(q, r, ["list"]).collect()}
    assert got == {text: ladder(text, hint, [x for x in records if x[4] == which]) for text, which, hint in queries}


def test_match_ladder_meets_few_rows_of_a_hot_list(spark):
    """20,000 records and 2,000 queries share one list: no row per pair comes out of the join."""
    records = spark.range(20_000).selectExpr("id AS record_id", "concat('Hot ', id % 500) AS name", "CAST(NULL AS DATE) AS released", "id AS pos", "'hot' AS list")
    queries = spark.range(2_000).selectExpr("concat('Hot ', id) AS query", "'hot' AS list", "2000 AS year_hint")
    got = ingest.best_match(queries, records, ["list"]).collect()
    assert len(got) == 2_000
    assert {r["query"]: (r["record_id"], r["tier"]) for r in got}["Hot 499"] == (499, 1)
    assert {r["query"]: r["tier"] for r in got}["Hot 1999"] == 3


def test_match_ladder_lists_no_prefix_that_nobody_asks_for(spark):
    """Every prefix of every record was sorted in the task that read it."""
    records = spark.range(100).selectExpr("id AS record_id", "concat('Hot ', id % 5) AS name", "CAST(NULL AS DATE) AS released", "id AS pos", "'hot' AS list")
    queries = spark.createDataFrame([("Hot", "hot", 2000), ("Hot 3", "hot", 2000)], "query STRING, list STRING, year_hint INT")
    best = ingest.best_match(queries, records, ["list"])
    assert "sequence(0, length" not in best._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["query"], r["record_id"], r["tier"]) for r in best.collect()} == {("Hot", 0, 2), ("Hot 3", 3, 1)}


def test_children_get_both_requirements_or_one_is_added(spark):
    children = spark.createDataFrame(
        [(1, 1, "Console", None, None), (1, 2, " pc ", "2001-01-01", None), (1, 3, "PC", None, None), (2, 1, "Console", None, None), (3, 1, "Windows", "", None), (4, 1, "PC", None, None)],
        "owner BIGINT, line INT, platform STRING, release_date STRING, platform_family STRING")
    extra = spark.createDataFrame(
        [(1, "min", None, "2020-02-02"), (2, None, "rec", None), (3, "min", "rec", "2020-03-03"), (4, None, "", "2020-04-04"), (5, "", None, "2020-05-05")],
        "owner BIGINT, requirements_minimum STRING, requirements_recommended STRING, release_date STRING")
    out = ingest.enrich_or_append(children, extra, "owner", ["line"], "platform")
    rows = {(r["owner"], r["line"]): (r["platform"], r["requirements_minimum"], r["requirements_recommended"], r["release_date"], r["platform_family"], r["added"]) for r in out.collect()}
    assert rows == {
        (1, 1): ("Console", None, None, None, None, False), (1, 2): (" pc ", "min", None, "2001-01-01", None, False),
        (1, 3): ("PC", None, None, None, None, False), (2, 1): ("Console", None, None, None, None, False),
        (2, None): ("PC", None, "rec", None, "PC", True), (3, 1): ("Windows", "min", "rec", "2020-03-03", None, False),
        (4, 1): ("PC", None, None, None, None, False),
    }


RECORD = """id STRING, name STRING, description STRING, released STRING, genres ARRAY<STRUCT<name: STRING>>, developers ARRAY<STRUCT<name: STRING>>,
  publishers ARRAY<STRUCT<name: STRING>>, tags ARRAY<STRUCT<name: STRING, language: STRING>>,
  shares ARRAY<STRUCT<title: STRING, percent: STRING, count: STRING>>, ratings STRUCT<average: STRING, critic: STRING>, platforms ARRAY<STRUCT<name: STRING>>"""


def test_flat_rows_of_odd_records(spark):
    rows = [
        ("7", "Seven", "text", "2020-05-06", [("A",), ("a",), (None,)], [("Dev",), ("",)], None, [("x", "eng"), ("y", "rus"), (None, "eng")],
         [("high", "61.5", "12"), ("low", None, "many")], ("4.5", "9"), [("PC",)]),
        ("bad", None, None, "soon", None, None, [], None, None, None, None),
    ]
    a, b = ingest.flatten_record(spark.createDataFrame(rows, RECORD)).orderBy("title").collect()[::-1]
    assert (a["game_id"], a["genres"], a["developers"], a["publishers"], a["tags"]) == (7, "A", "Dev", "", "x")
    assert [tuple(s) for s in a["rating_shares"]] == [("high", 61.5, 12), ("low", None, None)] and a["description"] == "text"
    assert (b["game_id"], b["genres"], b["tags"], b["rating_shares"], b["release_date"], b["has_platform_specs"]) == (None, "", "", None, None, False)


def test_reviews_and_articles(spark):
    kind = """id BIGINT, reviews ARRAY<STRUCT<title: STRING, score: STRING, publish_date: STRING, review_text: STRING, body: STRING>>,
      articles ARRAY<STRUCT<title: STRING, publish_date: STRING, deck: STRING, body: STRING>>"""
    rows = [(1, [("t", "8", "2020-01-02T10:00:00Z", "", "short"), ("u", "bad", "later", "long", None)], [("a", "2020-01-03", "d", "b")]), (2, None, None)]
    one, two = ingest.review_summary(spark.createDataFrame(rows, kind), ["id"]).orderBy("id").collect()
    assert one["average_score"] == 8.0 and two["average_score"] is None and two["items"] == [] and two["articles"] == []
    assert [tuple(i) for i in one["items"]] == [("t", "8", date(2020, 1, 2), "short"), ("u", "bad", None, "long")]
    assert [tuple(i) for i in one["articles"]] == [("a", "d", date(2020, 1, 3), "b")]
