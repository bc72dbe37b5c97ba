"""Stored tables: one build per version, nothing visible of a crashed one, retention."""

import shutil

import pytest

from lexmill.session import scratch_path, scratch_root
from lexmill.sources import store


def fresh(spark, rows):
    """A folder with one input table, and a name no other test uses."""
    d = scratch_path(spark, "inputs")
    spark.createDataFrame(rows, "id BIGINT, v STRING").write.parquet(f"{d}/part.parquet")
    return d, "t" + d[-12:]


def test_built_once_per_version(spark):
    d, name = fresh(spark, [(1, "a"), (2, None)])
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(f"{d}/part.parquet").selectExpr("id", "upper(v) AS v")

    def rows(**kw):
        return sorted((r["id"], r["v"]) for r in store.stored(spark, d, name, ["part"], build, **kw).collect())

    assert rows() == rows() == [(1, "A"), (2, None)] and len(calls) == 1
    spark.createDataFrame([(3, "c")], "id BIGINT, v STRING").write.mode("append").parquet(f"{d}/part.parquet")
    assert rows() == [(1, "A"), (2, None), (3, "C")] and len(calls) == 2
    assert rows(revision=2) == rows() and len(calls) == 3


def test_a_crashed_build_is_never_seen(spark):
    d, name = fresh(spark, [(1, "a")])

    def broken():
        return spark.range(8).selectExpr("id", "IF(id = 7, raise_error('lost'), 'x') AS v")

    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            store.stored(spark, d, name, ["part"], broken)
    good = store.stored(spark, d, name, ["part"], lambda: spark.range(2).selectExpr("id", "'y' AS v"))
    assert sorted(map(tuple, good.collect())) == [(0, "y"), (1, "y")]
    again = store.stored(spark, d, name, ["part"], broken)
    assert again.count() == 2
    # what the crashed builds left goes with the next clean-up, the published table stays
    assert store.retain(spark, name, keep=1, least_age=-1.0) and again.count() == 2


def test_retention_keeps_the_newest(spark):
    d, name = fresh(spark, [(1, "a")])
    tables = [store.stored(spark, d, name, ["part"], lambda: spark.range(1).selectExpr("id", "'z' AS v"), revision=r) for r in range(4)]
    assert store.retain(spark, name, keep=2) == []
    assert len(store.retain(spark, name, keep=2, least_age=-1.0)) == 2
    assert tables[3].count() == tables[2].count() == 1
    with pytest.raises(Exception):
        tables[0].count()
    assert store.retain(spark, "unknown" + name) == []
    shutil.rmtree(f"{scratch_root(spark)}/{store.FOLDER}/{name}".removeprefix("file://"))


def test_queries_share_the_store(spark):
    from lexmill.plans.candidates import chunks_of

    sf = "/root/testdata/sf0.001"
    assert chunks_of(spark, sf).inputFiles() == chunks_of(spark, sf).inputFiles()


def test_stored_tables_are_packed_tightly(spark):
    # keys and hashes are random hexadecimal digits: half a byte of information each
    d, name = fresh(spark, [(1, "a")])
    made = store.stored(spark, d, name, ["part"], lambda: spark.range(20_000).selectExpr("sha2(cast(id AS STRING), 256) AS h"))
    files = made.select("_metadata.file_path", "_metadata.file_size").distinct().collect()
    assert made.count() == 20_000 and sum(r["file_size"] for r in files) < 0.75 * 64 * 20_000
