from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import context, gate
from lexmill.schemas import CANDIDATES

TITLES = ["Far Cry 5", "Grand Theft Auto V", "Assassin's Creed Valhalla"]


def spans(spark, message, initial=False):
    return spark.createDataFrame([(message,)], "m STRING").select(gate.spans(F.col("m"), initial).alias("s")).first()["s"]


def test_spans(spark):
    assert spans(spark, "Tell me about Grand Theft Auto VI please") == ["grand theft auto vi"]
    assert spans(spark, "Far Cry 5 combat") == ["cry 5"]
    assert spans(spark, "Far Cry 5 combat", True) == ["far cry 5"]
    assert spans(spark, "is Legend of Zelda good") == ["legend of zelda"]
    assert spans(spark, "Doom Eternal and Crusader Kings III", True) == ["doom eternal", "crusader kings iii"]
    assert spans(spark, "what is the release date?") == []
    assert spans(spark, "in Assassin’s Creed Valhalla") == ["assassin's creed valhalla"]


def grounded(spark, message, evidence=()):
    q = spark.createDataFrame([(1, message)], "query_id BIGINT, m STRING")
    t = spark.createDataFrame([(x,) for x in TITLES], "title STRING")
    e = spark.createDataFrame(list(evidence), "query_id BIGINT, source_title STRING, source_type STRING")
    return gate.grounding(q, "m", t, "title", e).first()["grounded"]


def test_grounding(spark):
    assert grounded(spark, "Will there be a Grand Theft Auto VI?") is False
    assert grounded(spark, "What is the release date?") is None
    assert grounded(spark, "Far Cry 5 combat") is True
    assert grounded(spark, "Tell me about Assassin’s Creed Valhalla") is True
    assert grounded(spark, "is It Takes Two fun", [(1, "It Takes Two Review", "local")]) is True
    assert grounded(spark, "is It Takes Two fun", [(1, "It Takes Two Review", "web")]) is False
    assert grounded(spark, "about Beyond Good and Evil 2", [(1, "Resident Evil 2", "local")]) is False


def cands(spark, rows):
    full = [(1, i, f"c{i}", r.get("content", f"text number {i}"), r.get("title", "T"), r.get("type", "local"), r.get("url"),
             r.get("index"), r.get("ctx"), float(r.get("score", 0.0)), r.get("rr")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, CANDIDATES)


def verdict(spark, rows, provider="local"):
    q = spark.createDataFrame([(1,)], "query_id BIGINT")
    g = spark.createDataFrame([(1, None)], "query_id BIGINT, grounded BOOLEAN")
    noted = gate.annotate(cands(spark, rows))
    r = gate.verdicts(q, gate.relevance_aggregate(noted), g, [provider]).first()
    return r["status"], r["reason"]


def test_verdict_ladder(spark):
    assert verdict(spark, []) == ("quality_empty", "no_evidence")
    assert verdict(spark, [{"title": "Official Store Page", "rr": 9.0}]) == ("quality_weak", "only_noise")
    assert verdict(spark, [{"rr": -4.0}]) == ("quality_empty", "below_refuse_floor")
    assert verdict(spark, [{"rr": 1.0}]) == ("quality_weak", "below_weak_floor")
    assert verdict(spark, [{"rr": 3.0}]) == ("quality_ok", "sufficient")
    assert verdict(spark, [{"rr": None}]) == ("quality_ok", "floor_skipped")
    assert verdict(spark, [{"rr": -9.0}], "voyage") == ("quality_ok", "floor_skipped")
    assert verdict(spark, [{"rr": 1.0}, {"rr": 9.0, "type": "web"}]) == ("quality_weak", "web_clamped")
    assert verdict(spark, [{"rr": 9.0, "type": "web"}]) == ("quality_empty", "web_clamped")


def test_decompose(spark):
    q = "What is the comparison and differences between A and B"
    df = spark.createDataFrame([(q,), ("alone",), ("and B",)], "m STRING").select(gate.decompose(F.col("m")).alias("p"))
    assert [r["p"] for r in df.collect()] == [["What is the comparison and differences between A", "B"], ["alone"], ["and B"]]


def test_intent_and_task(spark):
    df = spark.createDataFrame([("Top 5 things, latest  update",), ("what is X",), ("between A and B",), ("hello",)], "m STRING")
    s = gate.intent_signals(F.col("m"))
    rows = df.select(s.alias("s"), gate.primary_task(s).alias("t"), gate.strategy(gate.primary_task(s), s).alias("c")).collect()
    assert [r["t"] for r in rows] == ["listicle", "factual", "comparison", "open"]
    assert rows[0]["s"] == ["listicle", "temporal"] and rows[0]["c"]["web"] and not rows[1]["c"]["web"] and rows[3]["c"]["web"]


def order(spark, fn, rows):
    return [r["chunk_uuid"] for r in fn(cands(spark, rows), ["query_id"]).orderBy("rank").collect()]


def test_relevance_is_all_or_nothing(spark):
    full = [{"score": 0.01, "rr": 9.0}, {"score": 0.03, "rr": -5.0}]
    assert order(spark, context.relevance_order, full) == ["c0", "c1"]
    assert order(spark, context.relevance_order, [{"score": 0.01, "rr": 9.0}, {"score": 0.03}]) == ["c1", "c0"]


def test_comparison_order(spark):
    rows = [{"ctx": "A", "score": 1}, {"ctx": "B", "score": 2}, {"ctx": "A", "score": 5}, {"score": 9}, {"ctx": "fallback", "score": 7}]
    assert order(spark, context.comparison_order, rows) == ["c2", "c1", "c3", "c4", "c0"]


def test_list_order(spark):
    rows = [{"score": 1}, {"index": 2, "score": 9}, {"index": 0, "score": 0}, {"score": 5}]
    assert order(spark, context.list_order, rows) == ["c2", "c1", "c3", "c0"]


def test_dedupe_keeps_first_place_and_longest_row(spark):
    rows = [{"content": "a big Dog"}, {"content": "something else"}, {"content": "a   big dog!"}]
    out = context.dedupe_longest(cands(spark, rows), ["query_id"]).orderBy("pos").collect()
    assert [(r["pos"], r["chunk_uuid"]) for r in out] == [(0, "c2"), (1, "c1")]


def test_pack_counts_redundant_rows_and_skips_large_ones(spark):
    rows = [{"content": "alpha beta gamma", "score": 9}, {"content": "alpha beta delta", "score": 8}, {"content": "x" * 60, "score": 7}, {"content": "omega psi", "score": 6}]
    packed = context.budget_pack(context.relevance_order(cands(spark, rows), ["query_id"]), ["query_id"], cap=40)
    got = context.packed_rows(packed, ["query_id"]).orderBy("rank").collect()
    assert [(r["chunk_uuid"], r["used_chars"], r["redundant"]) for r in got] == [("c0", 16, 1), ("c3", 25, 1)]


def test_refine_web(spark):
    rows = [{"score": 0.9, "url": "https://reddit.com/x"}, {"score": 0.7, "url": "https://reddit.com/y"}, {"score": 0.6, "url": "https://a.b"},
            {"score": 0.4}, {"score": 0.9, "title": "Deal"}, {"score": 0.5}, {"score": 0.99}]
    out = gate.refine_web(cands(spark, rows)).orderBy("pos").collect()
    assert [r["chunk_uuid"] for r in out] == ["c0", "c2", "c5"]


def test_first_name_token(spark):
    """As the first of all tokens; a text without one has none instead of failing."""
    said = ["  ¿O’Neill’s x", "a b", "", "¡!", None, "éa1 b", "’tis"]
    df = spark.createDataFrame([(s,) for s in said], "s STRING")
    got = df.select(text.first_name_token(F.col("s")).alias("a"), F.get(text.name_tokens(F.col("s")), F.lit(0)).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == ["O'Neill's", "a", None, None, None, "a1", "'tis"]


def test_opening_titles_of_texts_without_a_word(spark, tmp_path):
    from lexmill.plans.gating import opening_titles

    spark.createDataFrame([(1, "¡!"), (2, "Word two"), (3, None)], "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id BIGINT, quality INT").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r["title"] for r in opening_titles(spark, str(tmp_path)).collect()] == ["Word"]
