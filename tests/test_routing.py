"""Routed retrieval over a few literal texts."""

from pyspark.sql import functions as F

from lexmill.operators import context, gate, routing

CHUNKS = [
    ("u1", "amber castle stands on a hill", "Amber Castle", 3), ("u2", "amber castle has a long history", "Amber Castle", 1),
    ("u3", "blue harbour lies by the sea", "Blue Harbour", 0), ("u4", "blue harbour and amber castle share a road", "Roads", 2),
    ("u5", "nothing of note", "Other", 5),
]


def candidates(spark, questions):
    chunks = spark.createDataFrame(CHUNKS, "chunk_uuid STRING, content STRING, source STRING, chunk_index INT")
    asked = routing.routed(spark.createDataFrame(questions, "query_id BIGINT, text STRING"))
    return asked, routing.routed_candidates(asked, chunks)


def test_a_comparison_has_two_entities(spark):
    asked, rows = candidates(spark, [(7, "Amber Castle vs Blue Harbour")])
    assert asked.first()["task"] == "comparison" and asked.first()["limit"] == 5
    got = rows.orderBy("pos").collect()
    # the shared text comes once, with the part that found it first
    assert sorted(r["chunk_uuid"] for r in got) == ["u1", "u2", "u3", "u4"] and [r["pos"] for r in got] == [1, 2, 3, 4]
    parts = {r["chunk_uuid"]: r["retrieval_context"] for r in got}
    assert parts == {"u1": "Amber Castle", "u2": "Amber Castle", "u4": "Amber Castle", "u3": "Blue Harbour"}
    balance = gate.entity_balance(rows).first()
    assert (balance["entities"], balance["max_n"], balance["min_n"], balance["unbalanced"]) == (2, 3, 1, False)
    first = context.comparison_order(rows, ["query_id"]).orderBy("rank").select("retrieval_context").limit(2).collect()
    assert [r["retrieval_context"] for r in first] == ["Amber Castle", "Blue Harbour"]


def test_last_separator_splits(spark):
    asked = routing.routed(spark.createDataFrame(
        [(1, "What is the comparison and differences between Amber Castle and Blue Harbour")], "query_id BIGINT, text STRING"))
    parts = [r["sub_query"] for r in routing.sub_queries(asked).orderBy("part_no").collect()]
    assert parts == ["What is the comparison and differences between Amber Castle", "Blue Harbour"]


def test_limits_and_orders_follow_the_task(spark):
    many = [(f"v{i:02d}", f"top list of towers number {i}", "T", 40 - i) for i in range(20)]
    chunks = spark.createDataFrame(many, "chunk_uuid STRING, content STRING, source STRING, chunk_index INT")
    questions = [(1, "top 10 towers"), (2, "what is the latest tower list"), (3, "what is number 4"), (4, "towers"), (5, "zebra"), (6, None)]
    asked = routing.routed(spark.createDataFrame(questions, "query_id BIGINT, text STRING"))
    settings = {r["query_id"]: (r["task"], r["limit"], r["web"]) for r in asked.collect()}
    assert settings[1] == ("listicle", 10, False) and settings[2] == ("factual", 7, True)
    assert settings[3] == ("factual", 5, False) and settings[4] == ("open", 5, True)
    rows = routing.routed_candidates(asked, chunks)
    sizes = {r["query_id"]: r["count"] for r in rows.groupBy("query_id").count().collect()}
    assert sizes == {1: 10, 2: 7, 3: 5, 4: 5}
    listed = [r["chunk_index"] for r in rows.where("query_id = 1").orderBy("pos").collect()]
    assert listed == sorted(listed)
    assert rows.where(F.col("retrieval_context").isNotNull()).count() == 0
