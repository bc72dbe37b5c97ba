"""Distributed forms against brute force: order statistics, retrieval, history, streams."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.functions import ranking, text
from lexmill.functions.joins import salted_join
from lexmill.operators import chunking, context, evaluate, gate, integrity, retrieval
from lexmill.session import scratch_path
from lexmill.sources import tables
from lexmill.streaming import streams

SF = "/root/testdata/sf0.001"


def test_quantiles_match_numpy(spark):
    values = np.random.default_rng(1).exponential(10, 5000).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    stats = ranking.ordered_stats(ranking.value_counts(df, "v"), "v", ["n"])
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    row = stats.agg(*ranking.interpolated(stats, "v", probs)).first()
    assert [row[k] for k in probs] == pytest.approx([np.quantile(values, p) for p in probs.values()])
    row = stats.agg(*ranking.nearest_rank("v", probs)).first()
    assert [row[k] for k in probs] == [np.sort(values)[int(np.ceil(p * len(values))) - 1] for p in probs.values()]


def test_ordered_stats_with_one_hot_value(spark):
    df = spark.createDataFrame([(1.0,)] * 500 + [(float(i),) for i in range(2, 60)], "v DOUBLE")
    rows = ranking.ordered_stats(ranking.value_counts(df, "v"), "v", ["n"]).orderBy("v").collect()
    assert rows[0]["cum_n"] == 500 and rows[-1]["cum_n"] == rows[-1]["tot_n"] == 558
    assert [r["next_v"] for r in rows[:-1]] == [r["v"] for r in rows[1:]] and rows[-1]["next_v"] is None


def test_threshold_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(float(s), bool(p)) for s, p in zip(rng.normal(size=300).round(2), rng.random(300) < 0.3)]
    row = evaluate.best_threshold(spark.createDataFrame(data, "s DOUBLE, y BOOLEAN"), "s", "y").first()

    def f1(t):
        tp = sum(y and s < t for s, y in data)
        fp = sum(not y and s < t for s, y in data)
        fn = sum(y and s >= t for s, y in data)
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    cuts = sorted({s for s, _ in data})
    cuts.append(cuts[-1] + 1e-6)
    best = max(cuts, key=f1)
    assert row["threshold"] == pytest.approx(best, abs=1e-6) and row["f1"] == pytest.approx(f1(best), abs=1e-4)


def test_salted_join_equals_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else str(i)) for i in range(300)], "id INT, k STRING")
    small = spark.createDataFrame([("hot", 1), ("3", 2)], "k STRING, v INT")
    for how in ("inner", "left"):
        a = sorted(map(tuple, salted_join(big, small, ["k"], "id", how).select("id", "k", "v").collect()))
        assert a == sorted(map(tuple, big.join(small, "k", how).select("id", "k", "v").collect()))


@pytest.mark.parametrize("budget", [0, 50, 2000, 10**9])
def test_bounds_do_not_change_bm25(spark, budget):
    """Whatever the rarest terms bring, the lists are those of all matches scored in full."""
    docs = tables.table(spark, SF, "documents").select("doc_id", "text")
    queries = tables.table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text").limit(12)
    got = retrieval.bm25_topk(queries, docs.repartition(3), "doc_id", "text", 5, budget=budget).collect()
    texts = {r["doc_id"]: _tokens(r["text"]) for r in docs.collect()}
    mean = np.mean([len(t) for t in texts.values()])
    want = []
    for q in queries.collect():
        terms = set(_tokens(q["text"]))
        total = {}
        for term in sorted(terms):
            holding = {i: t.count(term) for i, t in texts.items() if term in t}
            idf = np.log(1 + (len(texts) - len(holding) + 0.5) / (len(holding) + 0.5))
            for i, tf in holding.items():
                total[i] = total.get(i, 0.0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[i]) / mean))
        best = sorted((-round(s, 4), i) for i, s in total.items())[:5]
        want += [(q["query_id"], n + 1, i, pytest.approx(-s, abs=2e-4)) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[:3])


def _tokens(body):
    return [w for w in re.split(r"[^\w]+", body.lower()) if w]


def test_bm25_plan_does_not_grow_with_the_queries(spark):
    docs = tables.table(spark, SF, "documents").select("doc_id", "text")
    queries = tables.table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    many = queries.crossJoin(spark.range(30)).select((F.col("query_id") * 30 + F.col("id")).alias("query_id"), "text")
    plans = [retrieval.bm25_topk(q, docs, "doc_id", "text", 5)._jdf.queryExecution().executedPlan().toString() for q in (queries, many)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") and "Python" not in plans[1]


def test_bm25_limit_per_query(spark):
    docs = spark.createDataFrame([(i, "a b " * (i + 1)) for i in range(9)], "doc_id BIGINT, text STRING")
    queries = spark.createDataFrame([(1, "a", 2), (2, "b", 7), (3, "z", 4)], "query_id BIGINT, text STRING, most INT")
    got = retrieval.bm25_topk(queries, docs, "doc_id", "text", "most").groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {1: 2, 2: 7}


def test_bm25_without_texts_or_terms(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id BIGINT, text STRING")
    queries = spark.createDataFrame([(1, "a a"), (2, None), (3, "z")], "query_id BIGINT, text STRING")
    assert [r["doc_id"] for r in retrieval.bm25_topk(queries, docs, "doc_id", "text", 5).collect()] == [3, 3]
    assert retrieval.bm25_topk(queries, docs.limit(0), "doc_id", "text", 5).count() == 0
    assert retrieval.bm25_topk(queries.limit(0), docs, "doc_id", "text", 5).count() == 0


def test_bm25_hands_over_no_row_per_query_and_text(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    queries = spark.range(60).select(F.col("id").alias("query_id"), F.lit("a b").alias("text"))
    written, keep = [], retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, label: (out := keep(df, label), written.append(out.count()))[0])
    got = retrieval.bm25_topk(queries, docs, "doc_id", "text", 5, group_terms=50).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got) == [(q, n + 1, n) for q in range(60) for n in range(5)]
    assert max(written) <= 3 * 300


def test_bm25_ties_and_rows_without_key(spark):
    docs = spark.createDataFrame([(None, "a"), (7, "a"), (2**60 + 1, "a"), (2**60, "a"), (5, "b")], "doc_id BIGINT, text STRING")
    queries = spark.createDataFrame([(2**61 + 1, "a")], "query_id BIGINT, text STRING")
    got = retrieval.bm25_topk(queries, docs.repartition(3), "doc_id", "text", 3).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(2**61 + 1, None), (2**61 + 1, 7), (2**61 + 1, 2**60)]


def test_dense_topk_is_exact_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE_QUERIES", 7)
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(200, 8)), rng.normal(size=(20, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id BIGINT, vec ARRAY<DOUBLE>")
    queries = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id BIGINT, vec ARRAY<DOUBLE>")
    got = retrieval.dense_topk(queries, vectors, 5).collect()
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    want = {(i, r + 1, int(j)) for i in range(20) for r, j in enumerate(np.argsort(-cos[i])[:5])}
    assert {(g["query_id"], g["rank"], g["id"]) for g in got} == want


def test_dense_blocks_are_bounded_by_cells(spark, monkeypatch):
    from types import SimpleNamespace

    monkeypatch.setattr(retrieval, "BLOCK_CELLS", 90, raising=False)
    seen, rows = [], pd.DataFrame({"id": range(40), "query_id": range(40), "vec": [[1.0, float(i)] for i in range(40)]})
    kept = lambda cos, ids: (seen.append(cos.size), np.nonzero(cos > 0.999))[1]
    both = SimpleNamespace(applyInPandas=lambda score, schema: score(rows, rows))
    grouped = SimpleNamespace(cogroup=lambda other: both)
    frame = SimpleNamespace(withColumn=lambda *_: frame, withColumnsRenamed=lambda *_: frame, groupBy=lambda *_: grouped)
    out = retrieval._scored_tiles(frame, frame, 40, kept)
    unit = np.array(rows["vec"].tolist()) / np.linalg.norm(rows["vec"].tolist(), axis=1, keepdims=True)
    assert max(seen) <= 90 and len(out) == (np.round(unit @ unit.T, 6) > 0.999).sum()


def _clusters(seed, clusters, each, dim=8):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.normal(size=(clusters, dim)), each, axis=0) + rng.normal(scale=0.02, size=(clusters * each, dim))


def test_balls_leave_out_pairs_and_no_result(spark, monkeypatch):
    for name, value in {"BALL_VECTORS": 20, "TILE_VECTORS": 30, "SAMPLE_VECTORS": 300, "GROUP_QUERIES": 11, "TILE_QUERIES": 4}.items():
        monkeypatch.setattr(retrieval, name, value)
    v = np.vstack([_clusters(1, 30, 20), np.zeros((3, 8)), np.random.default_rng(2).normal(size=(40, 8))])
    q = np.vstack([v[::31], np.zeros((1, 8)), np.random.default_rng(3).normal(size=(4, 8))])
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9999, None)], "id BIGINT, vec ARRAY<DOUBLE>")
    queries = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id BIGINT, vec ARRAY<DOUBLE>")
    cos = np.round(retrieval._unit(pd.Series(list(q))) @ retrieval._unit(pd.Series(list(v))).T, 6)
    want = {(i, n + 1, int(j)) for i in range(len(q)) for n, j in enumerate(np.lexsort((np.arange(len(v)), -cos[i]))[:5])}
    got = retrieval.dense_topk(queries, vectors, 5).collect()
    assert {(g["query_id"], g["rank"], g["id"]) for g in got} == want
    pairs = {(r["query_id"], r["id"]) for r in retrieval.dense_candidates(queries, vectors, 0.9).collect()}
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(cos >= 0.9))}
    plan = retrieval.dense_plan(queries.where("query_id < 20"), vectors, 5, None)
    assert retrieval.dense_pairs_scored(*plan).first()["pairs"] < 0.5 * 20 * len(v)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_lsh_recall(spark, sf):
    import __spark_entry__ as e

    rows = e.queries()["dense_topk_lsh"](spark, f"/root/testdata/{sf}").select("query_id", "recall", "met").distinct().collect()
    assert sum(r["recall"] for r in rows) / len(rows) >= 0.9
    assert sum(r["met"] for r in rows) < 0.7 * len(rows) * tables.table(spark, f"/root/testdata/{sf}", "embeddings").count()


def test_lsh_scores_few_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16))
    v = np.repeat(centres, 20, axis=0) + rng.normal(scale=0.05, size=(1200, 16))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    vectors = spark.createDataFrame(rows, "id BIGINT, vec ARRAY<DOUBLE>")
    queries = spark.createDataFrame(rows[::40], "query_id BIGINT, vec ARRAY<DOUBLE>")
    near = retrieval.dense_topk_lsh(queries, vectors, 10, 16).collect()
    true = {(r["query_id"], r["id"]) for r in retrieval.dense_topk(queries, vectors, 10).collect()}
    assert len({(r["query_id"], r["id"]) for r in near} & true) >= 0.9 * len(true)
    assert max(r["met"] for r in near) < 500


def test_lsh_visits_are_looked_up_inside_tiles(spark, monkeypatch):
    """Vectors without clusters need many flips: a row per visited bucket, 16 copies of each broadcast, filled the driver."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 24))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    vectors = spark.createDataFrame([*rows, (9999, None)], "id BIGINT, vec ARRAY<DOUBLE>")
    queries = spark.createDataFrame(rows[::100], "query_id BIGINT, vec ARRAY<DOUBLE>")
    plans, flips = {}, []
    write, fit = retrieval.materialize, retrieval.probe_bits
    monkeypatch.setattr(retrieval, "materialize", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()) and write(df, label))
    monkeypatch.setattr(retrieval, "probe_bits", lambda *a: flips.append(fit(*a)) or flips[0])
    near = retrieval.dense_topk_lsh(queries, vectors, 10, 24, bands=6).collect()
    bits = retrieval.band_bits(3001)
    assert 1 < flips[0] < bits and "Join" not in plans["scored"]
    # all pairs, tested bit by bit
    dots = (v @ retrieval.sign_planes(6 * bits, 24).T).reshape(3000, 6, bits)
    cos = np.round(retrieval._unit(pd.Series(list(v[::100]))) @ retrieval._unit(pd.Series(list(v))).T, 6)
    want = set()
    for i, q in enumerate(dots[::100]):
        fixed = np.argsort(np.round(np.abs(q), 9), axis=1, kind="stable")[:, flips[0]:]
        same = (np.take_along_axis(dots > 0, fixed[None], 2) == np.take_along_axis(q > 0, fixed, 1)[None]).all(axis=2).any(axis=1)
        at = np.flatnonzero(same)
        at = at[np.lexsort((at, -cos[i][at]))][:10]
        want |= {(100 * i, n + 1, int(j), int(same.sum())) for n, j in enumerate(at)}
    assert {(r["query_id"], r["rank"], r["id"], r["met"]) for r in near} == want


@pytest.mark.parametrize("flips", [0, 2, 5])
def test_lsh_lookup_and_test_agree(flips):
    rng = np.random.default_rng(flips)
    buckets, asked = rng.integers(0, 64, (40, 3)), rng.integers(0, 64, (7, 3))
    masks = np.array([[sum(1 << int(x) for x in rng.permutation(6)[:flips]) for _ in range(3)] for _ in range(7)])
    want = (((buckets[None] ^ asked[:, None]) & ~masks[:, None]) == 0).any(axis=2)
    assert (np.concatenate([met for _, met in retrieval._met(buckets, asked, masks)]) == want).all()


def test_rerank_falls_back_as_a_whole(spark):
    rows = [(1, 1, 10, 0.5, ["a"], ["a"]), (1, 2, 11, 0.4, ["a"], []), (2, 1, 12, 0.5, ["a", "b"], ["a"]), (2, 2, 13, 0.4, ["a", "b"], ["a", "b"])]
    df = spark.createDataFrame(rows, "query_id BIGINT, rank INT, id BIGINT, score DOUBLE, q ARRAY<STRING>, c ARRAY<STRING>")
    got = retrieval.rerank(df, "id", "q", "c", 2).orderBy("query_id", "rank").collect()
    assert [(r["id"], r["rerank_score"]) for r in got] == [(10, None), (11, None), (13, 6.0), (12, 0.0)]


def test_history_carries_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "HISTORY_BLOCK", 5)
    turns = [0, 1, 2, 3, 4, 5, 11, 12, 26, 27]
    df = spark.createDataFrame([(1, t, "user", f"m{t}") for t in turns], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    got = {r["turn"]: r["history"] for r in evaluate.conversation_history(df).collect()}
    for i, t in enumerate(turns):
        want = "\n".join(f"user: m{x}" for x in turns[max(0, i - 4):i]) or "(none)"
        assert got[t] == want


def test_centroid_split(spark):
    rng = np.random.default_rng(7)
    near = lambda axis: [float(x) for x in np.eye(8)[axis] + rng.normal(scale=0.02, size=8)]
    rows = [(i, near(0)) for i in range(20)] + [(20 + i, near(1)) for i in range(6)]
    out = integrity.centroid_split(spark.createDataFrame(rows, "id BIGINT, vec ARRAY<DOUBLE>"), "vec", 8).collect()
    assert {r["id"] for r in out if r["side"] == "low"} == set(range(20, 26))
    same = integrity.centroid_split(spark.createDataFrame(rows[:20], "id BIGINT, vec ARRAY<DOUBLE>"), "vec", 8)
    assert same.where("side IS NOT NULL").count() == 0


def test_confusion_rates(spark):
    rows = [(True, True, False)] * 9 + [(True, False, False)] + [(False, False, False)] * 39 + [(False, True, False)] + [(True, True, True)]
    r = evaluate.confusion(spark.createDataFrame(rows, "should_refuse BOOLEAN, refused BOOLEAN, errored BOOLEAN")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["errored"]) == (9, 1, 1, 39, 1)
    assert (r["precision"], r["false_answer_rate"], r["over_refusal_rate"]) == (0.9, 0.1, 0.025)


def test_answer_issues(spark):
    rows = [("", ["a"]), ("x (Source: 'Far Cry 5')", ["far cry 5 review"]), ("**x (Source: 'Z')", ["a"]), ("plain", [])]
    df = spark.createDataFrame(rows, "answer STRING, titles ARRAY<STRING>")
    got = [r[0] for r in df.select(evaluate.answer_issues(F.col("answer"), F.lit(False))).collect()]
    assert got == [["empty"], [], ["unclosed_bold", "unmatched_citation"], ["no_citation"]]


def test_insert_if_absent_and_overwrite(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, v STRING")
    new = spark.createDataFrame([(2, "x"), (3, "c")], "id INT, v STRING")
    after, inserted = tables.insert_if_absent(old, new.union(new), "id")
    assert sorted(map(tuple, after.collect())) == [(1, "a"), (2, "b"), (3, "c")] and inserted.count() == 1


def test_jsonl_skips_blank_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": 1}\n\n  \n{"id": 2}\n')
    assert [r["id"] for r in tables.read_jsonl(spark, str(tmp_path), "id INT").orderBy("id").collect()] == [1, 2]


def test_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = {r["chunk_uuid"] for r in streams.stream_ingest_chunks(spark, SF).select("chunk_uuid").collect()}
    assert want and {r["chunk_uuid"] for r in streams.stream_ingest_chunks(spark, str(tmp_path)).select("chunk_uuid").collect()} == want


def test_stream_replay_adds_nothing(spark):
    table = scratch_path(spark, "replay")
    streams.new_table(spark, table, streams.CHUNK_ROWS)
    counts = []
    for n in range(2):
        # the second pass has no memory of the first: only the anti join stops repeats
        streams.ingest_chunks(spark, SF, table, scratch_path(spark, "state"))
        rows = streams.read_batches(spark, table, streams.CHUNK_ROWS)
        counts.append((rows.count(), rows.select("chunk_uuid").distinct().count()))
    assert counts[0] == counts[1] and counts[0][0] == counts[0][1] > 0
    assert sorted(r["n"] > 0 for r in rows.groupBy("run").agg(F.count("*").alias("n")).collect()) == [True]


def test_late_rows_and_repeated_batches_change_nothing(spark, tmp_path):
    whole = spark.read.parquet(f"{SF}/events.parquet")
    for n, part in enumerate(("event_id % 3 = 2", "event_id % 3 = 0", "event_id % 3 = 1")):
        # the first files hold the newest days
        rows = whole.where(part).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {40 - 20 * n} DAYS"))
        rows.coalesce(1).write.parquet(f"{tmp_path}/raw{n}")
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir()
    many.mkdir()
    rows = None
    for n in range(3):
        file = next((tmp_path / f"raw{n}").glob("part-*.parquet"))
        (many / f"events{n}.parquet").write_bytes(file.read_bytes())
        part = spark.read.parquet(str(file))
        rows = part if rows is None else rows.union(part)
    rows.coalesce(1).write.parquet(f"{tmp_path}/all")
    (one / "events.parquet").write_bytes(next((tmp_path / "all").glob("part-*.parquet")).read_bytes())
    for job in (streams.stream_usage_daily, streams.stream_latency_windows):
        batch = sorted(map(str, job(spark, str(one)).collect()))
        assert batch == sorted(map(str, job(spark, str(many), files_per_batch=1).collect())) and batch


def test_late_rows_are_counted_and_compaction_changes_nothing(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    whole = spark.read.parquet(f"{SF}/events.parquet").limit(60).collect()
    import datetime as dt

    days, folder = [10, 8, 10, 3], tmp_path / "in"
    folder.mkdir()
    held = None
    for n, day in enumerate(days):
        rows = [{**r.asDict(), "ts": dt.datetime(2024, 1, day, 12)} for r in whole[15 * n : 15 * n + 15]]
        spark.createDataFrame([tuple(r[f] for f in schema.names) for r in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/raw{n}")
        (folder / f"events{n}.parquet").write_bytes(next((tmp_path / f"raw{n}").glob("part-*.parquet")).read_bytes())
        stream = streams.usage_stream(spark, str(folder))
        held = held or streams.usage_table(spark, stream.schema)
        held.consume(stream)
        before = sorted(map(str, held.totals().collect()))
        if n in (1, 2):
            assert held.compact() == n == held.base()["upto"]
            assert sorted(map(str, held.totals().collect())) == before
    assert sorted(map(tuple, held.late_rows().collect())) == [(1, 2, 15), (3, 7, 15)]
    # a batch that is already in the base is written again
    again = streams.usage_stream(spark, str(folder)).schema
    repeat = spark.read.parquet(f"{tmp_path}/raw1")
    repeat = repeat.select("*").withColumn("provider", F.lit("groq")).withColumn("surface", F.lit("chat")).withColumn(
        "prompt_tokens", F.lit(1).cast("bigint")).withColumn("completion_tokens", F.lit(1).cast("bigint")).withColumn("fallback", F.lit(0).cast("bigint"))
    held.save(repeat.select(*again.names), 1)
    assert sorted(map(str, held.totals().collect())) == before
    assert held.compact() == 3 and sorted(map(str, held.totals().collect())) == before and held.compact() == 3


def test_smallest_owner_whatever_arrives_first(spark, tmp_path):
    body = " ".join(f"word{i} of a long enough sentence." for i in range(120))
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for n, i in enumerate((9, 3, 5)):
        spark.createDataFrame([(i, body, "en", "s", len(body))], schema).coalesce(1).write.parquet(f"{tmp_path}/raw{n}")
    folder = tmp_path / "in"
    folder.mkdir()
    table = scratch_path(spark, "owners")
    streams.new_table(spark, table, streams.CHUNK_ROWS)
    state = scratch_path(spark, "state")
    for n in range(3):
        (folder / f"documents{n}.parquet").write_bytes(next((tmp_path / f"raw{n}").glob("part-*.parquet")).read_bytes())
        streams.ingest_chunks(spark, str(folder), table, state)
    rows = streams.stored_chunks(spark, table).collect()
    assert rows and {r["doc_id"] for r in rows} == {3} and len({r["chunk_uuid"] for r in rows}) == len(rows)


def test_dimension_outlives_its_source(spark, tmp_path):
    now, path = [0.0], f"{tmp_path}/dim"
    spark.createDataFrame([(1, "a")], "k INT, v STRING").write.parquet(path)
    dim = streams.RefreshedDimension(lambda: spark.read.parquet(path), 10, lambda: now[0])
    assert dim.current().first()["v"] == "a"
    spark.createDataFrame([], "k INT, v STRING").write.mode("overwrite").parquet(path)
    now[0] = 11
    assert [r["v"] for r in dim.current().collect()] == ["a"]
    (tmp_path / "dim").rename(tmp_path / "gone")
    now[0] = 22
    assert [r["v"] for r in dim.current().collect()] == ["a"]
    spark.createDataFrame([(1, "b")], "k INT, v STRING").write.parquet(path)
    now[0] = 33
    assert [r["v"] for r in dim.current().collect()] == ["b"]


def test_results_the_tables_do_not_show(spark):
    titles = spark.createDataFrame([("Far Cry",)], "title STRING")
    asked = spark.createDataFrame([(1, "Tell me about Far Cry please"), (2, "what is it")], "query_id INT, m STRING")
    none = spark.createDataFrame([], "query_id INT, source_type STRING, source_title STRING")
    got = {r["query_id"]: r["grounded"] for r in gate.grounding(asked, "m", titles, "title", none).collect()}
    assert got == {1: True, 2: None}
    assert {r["grounded"] for r in gate.grounding(asked, "m", titles.limit(0), "title", none).collect()} == {None}

    said = spark.createDataFrame([("It is so (Source: 'Assassin\u2019s').", ["assassin's"])], "answer STRING, titles ARRAY<STRING>")
    assert said.select(evaluate.fidelity(F.col("answer")).alias("f")).select("f.grounded").first()[0] == 1

    chunks = spark.createDataFrame([(1, None, None), (2, 1, 50), (3, 1, 10_000_000)], "g INT, rank INT, chars INT")
    modes = {r["g"]: (r["mode"], r["chunks_used"]) for r in context.prompt_ladder(chunks, ["g"], "chars", 900, 400).collect()}
    assert modes == {1: ("verbose", 0), 2: ("verbose", 1), 3: ("truncated", 0)}
    assert {r["mode"] for r in context.prompt_ladder(chunks, ["g"], "chars", 900, 400, cap=300).collect()} == {"minimal"}

    kids = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("", "x"), (None, "x"), ("a", "")], "p STRING, s STRING")
    known = spark.createDataFrame([("a",), ("c",)], "p STRING")
    assert [tuple(r) for r in integrity.children_count(kids, known, "p", "s").collect()] == [("a", 2)]

    rows = spark.createDataFrame([(["b", "A", "a", "B", "c"],), ([],), (None,)], "v ARRAY<STRING>")
    firsts = [[(x["pos"], x["value"]) for x in r[0]] if r[0] is not None else None for r in rows.select(text.first_of_each(F.col("v"))).collect()]
    assert [sorted(f) if f else f for f in firsts] == [[(0, "b"), (1, "A"), (4, "c")], [], None]

    wanted = spark.createDataFrame([(1, "T"), (2, "U")], "query_id INT, expected STRING")
    lists = spark.createDataFrame([(1, 1, "t"), (1, 2, "z")], "query_id INT, pos INT, source_title STRING")
    assert {r["query_id"]: r["precision"] for r in evaluate.precision_at_k(lists, wanted, 5).collect()} == {1: 0.2, 2: 0.0}


def test_dimension_refresh(spark):
    now, versions = [0.0], [[(1, "a")], [], [(1, "b")]]
    dim = streams.RefreshedDimension(lambda: spark.createDataFrame(versions[min(dim.reads, 2)], "k INT, v STRING"), 10, lambda: now[0])
    assert dim.current().first()["v"] == "a"
    now[0] = 5
    assert dim.current().first()["v"] == "a" and dim.reads == 1
    now[0] = 11
    assert dim.current().first()["v"] == "a" and dim.reads == 2
    now[0] = 22
    assert dim.current().first()["v"] == "b"


def test_a_window_is_split_into_lines_once(spark):
    """A branch evaluates every mention of an expression again; the lines of a window were cut three times."""
    df = spark.createDataFrame([("a\nb",), ("x" * 40,), ("",), (None,)], "t string")
    judged = df.select("t", chunking.drop_reason(F.col("t")).alias("why"))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(t") == 2  # words and lines
    assert {r["t"]: r["why"] for r in judged.collect()} == {"a\nb": "list_like", "x" * 40: None, "": "list_like", None: None}


def test_best_texts_are_a_small_written_table(spark):
    """The join with the texts then goes by the true size of the list instead of moving every text."""
    docs = spark.createDataFrame([(i, f"word{i % 7} common text") for i in range(50)], "id bigint, body string")
    queries = spark.createDataFrame([(1, "word3 common"), (2, "word5")], "query_id bigint, text string")
    top = retrieval.bm25_topk(queries, docs, "id", "body", 3)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and tables.plan_bytes(top) < 1 << 20
    assert [r["id"] for r in top.where("query_id = 2").orderBy("rank").collect()] == [5, 12, 19]


def test_postings_are_a_row_per_text_and_move_nothing(spark, monkeypatch):
    """Terms are counted where a text is read, also over several batches, and alike when they are too many to broadcast."""
    docs = spark.createDataFrame([(1, "a b a c " * 40), (None, None), (2, ""), (3, "z " * 90 + "a"), (3, "b")], "doc_id BIGINT, text STRING")
    queries = spark.createDataFrame([(1, "a b"), (2, "z")], "query_id BIGINT, text STRING")
    plans, keep = {}, retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, label: (plans.update({label: df._jdf.queryExecution().executedPlan().toString()}), keep(df, label))[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = []
        for most in (retrieval.BROADCAST_TERMS, -1):
            monkeypatch.setattr(retrieval, "BROADCAST_TERMS", most)
            rows = retrieval.asked_postings(queries, docs.coalesce(1), "doc_id", "text")[1].collect()
            found.append(sorted((r["doc_id"] or 0, sorted(r["tfs"])) for r in rows))
            if most > 0:
                assert "hashpartitioning(row" not in plans["postings"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == [(0, []), (1, [40, 80]), (2, []), (3, [1]), (3, [1, 90])]


def test_routing_reads_each_turn_once(spark, tmp_path):
    """Repeated turns are rows of their own, and the rate over all cases does not judge the texts again."""
    from lexmill.plans import QUERIES

    rows = [(1, 0, "user", "a vs\nb"), (1, 0, "user", "a vs\nb"), (None, 1, "system", "what  is it"), (2, 0, "user", None), (3, 0, "assistant", "Top\n5 Best, x")]
    talk = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    talk.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert tuple(QUERIES["routing_accuracy_determinism"](spark, str(tmp_path)).first()) == (40.0, 100.0, 5)
    checks = QUERIES["regression_case_check"](spark, str(tmp_path))
    assert sorted(r["routing_ok"] for r in checks.collect()) == [False] * 3 + [True] * 2
    assert "text" not in checks._jdf.queryExecution().optimizedPlan().toString()


def test_task_of_a_line_is_the_task_of_its_signals(spark):
    from lexmill.operators import gate

    said = ["Best  of A vs B", "top 10", "top\n10 specs", "what is\tthe best", "best", "LATEST", "", None, "between x and y", "developer\x85history of"]
    df = spark.createDataFrame([(s,) for s in said], "s STRING")
    both = df.select(gate.task_of_line(gate.routing_line(F.col("s"))).alias("a"), gate.primary_task(gate.intent_signals(F.col("s"))).alias("b")).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both] and len({r["a"] for r in both}) == 4
