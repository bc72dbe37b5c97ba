"""Retrieval as a message's intent asks for it: its parts, its limit, its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import materialize
from . import gate, retrieval

#: A message has two parts at most.
PARTS = 2


def routed(queries: DataFrame) -> DataFrame:
    """query_id, text, signals, task and the settings limit, window, decompose and web."""
    signals = gate.intent_signals(F.col("text"))
    with_task = queries.select("query_id", "text", signals.alias("signals")).withColumn("task", gate.primary_task(F.col("signals")))
    return with_task.select("*", gate.strategy(F.col("task"), F.col("signals")).alias("s")).select("query_id", "text", "signals", "task", "s.*")


def sub_queries(asked: DataFrame) -> DataFrame:
    """One row per part of a message that is to be decomposed, else the whole message: part_id, part_no, sub_query."""
    parts = F.when(F.col("decompose"), gate.decompose(F.col("text"))).otherwise(F.array("text"))
    rows = asked.select("query_id", "task", "limit", F.posexplode(parts).alias("part_no", "sub_query"))
    return rows.withColumn("part_id", F.col("query_id") * PARTS + F.col("part_no"))


def routed_candidates(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidate rows of every message, in the order its task gives them.

    Each part is searched with the message's own limit; the parts of a comparison follow one another, every content
    once, where it came first, and name their part as ``retrieval_context``.  Lists are put in the order of their
    chunks.  Messages that find nothing have no rows.
    """
    parts = materialize(sub_queries(asked), "parts")
    searched = parts.select(F.col("part_id").alias("query_id"), F.col("sub_query").alias("text"), "limit")
    top = retrieval.bm25_topk(searched, chunks, "chunk_uuid", "content", "limit").withColumnRenamed("query_id", "part_id")
    rows = chunks.join(top, "chunk_uuid").join(parts, "part_id")
    compared = F.col("task") == "comparison"
    found = rows.select(
        "query_id", "task", "part_no", "rank", "chunk_uuid", "content", F.col("source").alias("source_title"),
        F.lit("local").alias("source_type"), F.lit(None).cast("string").alias("source_url"), "chunk_index",
        F.when(compared, F.col("sub_query")).alias("retrieval_context"), "score",
        retrieval.coverage_score(text.word_tokens(F.col("sub_query")), text.word_tokens(F.col("content"))).alias("rerank_score"),
    )
    # a list holds the limits of two parts at most
    same = Window.partitionBy("query_id", F.sha2("content", 256)).orderBy("part_no", "rank")
    once = found.withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    listed = F.when(F.col("task") == "listicle", F.coalesce("chunk_index", F.lit(0))).otherwise(0)
    order = Window.partitionBy("query_id").orderBy(listed, "part_no", "rank")
    return once.withColumn("pos", F.row_number().over(order)).drop("_nth", "part_no", "rank")
