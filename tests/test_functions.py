"""The SQL table function and the injected embedder."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lexmill.functions import sql
from lexmill.operators import chunking, integrity

TEXTS = [
    (1, "one two three", "T"), (2, None, "T"), (3, "", None), (4, "w " * 900, ""), (5, "&lt;b&gt; a&nbsp;b &eacute;&amp;lt; <i>x</i>\x1cy z", "É"),
    (6, "x" * 100_000, "T"), (7, "tail " * 320 + "é" * 9000, None),
]


def test_lateral_call_equals_chunk_words(spark):
    df = spark.createDataFrame(TEXTS, "doc_id BIGINT, text STRING, source STRING")
    sql.register(spark)
    got = spark.sql("SELECT d.doc_id, c.chunk_index, c.content FROM {df} d, LATERAL chunk_text(d.text, d.source) c", df=df)
    want = chunking.chunk_words(df, "text", "source", ["doc_id"]).select("doc_id", "chunk_index", "content")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_injected_embedder_sees_only_the_sample(spark):
    seen = spark.sparkContext.accumulator(0)

    def vector(text):
        return np.random.default_rng(zlib.crc32(text.encode())).normal(size=8)

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.map(lambda t: [float(x) for x in vector(t)])

    texts = [(i, f"text {i}") for i in range(40)]
    # rows from 20 on are stored with the vectors of this embedder, the others with some older one
    stored = [(i, [float(x) for x in (vector(t) if i >= 20 else vector("old" + t))]) for i, t in texts]
    clusters = spark.createDataFrame([("low" if i < 20 else "high", i % 20 + 1, i) for i, _ in texts], "side STRING, rank INT, id BIGINT")
    out = integrity.migrated_side_by(
        clusters, spark.createDataFrame(stored, "id BIGINT, vec ARRAY<DOUBLE>"), spark.createDataFrame(texts, "id BIGINT, text STRING"), embed, 3)
    rows = {r["side"]: (round(r["mean_cosine"], 3), r["migrated"]) for r in out.collect()}
    assert rows["high"] == (1.0, True) and rows["low"][1] is False and rows["low"][0] < 0.9
    assert seen.value <= 6 * 4


def test_rounded_as_duckdb(spark):
    """Quotients whose decimals end in 5, where Spark's own round goes another way than the SQL's."""
    import duckdb
    from lexmill.functions.numbers import rounded

    sql = "SELECT a, b, round(a / b, 4) AS x, round(-a / b, 6) AS y FROM range(1, 701) t(a), (SELECT unnest([7, 160, 640, 800, 3200, 4000, 20000])) s(b)"
    want = sorted(duckdb.connect().execute(sql).fetchall())
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([r[:2] for r in want], "a BIGINT, b BIGINT")
    rows = df.select("a", "b", rounded(a / b, 4).alias("x"), rounded(-a / b, 6).alias("y"), F.round(a / b, 4).alias("plain")).collect()
    assert sorted(tuple(r)[:4] for r in rows) == want
    assert sum(r["plain"] != r["x"] for r in rows) > 20


def test_best_threshold_rounds_as_the_sql(spark):
    from lexmill.operators import evaluate

    df = spark.createDataFrame([(1.0, i < 57) for i in range(800)], "score DOUBLE, bad BOOLEAN")
    best = evaluate.best_threshold(df, "score", "bad").collect()
    assert [tuple(r) for r in best] == [(1.000001, 0.0712, 1.0, 0.133, 57, 743, 0, 0)]
    assert evaluate.best_threshold(df.limit(0), "score", "bad").collect() == []
