"""Candidate tables the gate, context and evaluation queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text
from ..operators import chunking, gate, retrieval
from ..sources.store import stored
from ..sources.tables import spread, table

WEB_RESULTS = 5


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def windows_of(spark: SparkSession, d: str) -> DataFrame:
    """All windows of the documents, kept and dropped ones apart, cut once per version of the documents."""
    return stored(spark, d, "windows", ["documents"], lambda: chunking.judged_windows(docs_of(spark, d)), split_by="reason")


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """The chunk store: the kept windows less the stored list of later copies."""
    windows = windows_of(spark, d)
    keys = windows.where(F.col("reason") == chunking.KEPT).select("row", "chunk_uuid", "doc_id", "chunk_index")
    copies = stored(spark, d, "copies", ["documents"], lambda: chunking.later_copies(keys))
    return chunking.chunks_from(windows, copies)


def coverage(query: Column, body: Column) -> Column:
    return retrieval.coverage_score(text.word_tokens(query), text.word_tokens(body))


def local_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Best chunks per benchmark passage, scored whatever their language; one table per version of both."""
    def build() -> DataFrame:
        queries, chunks = queries_of(spark, d), chunks_of(spark, d)
        top = retrieval.bm25_topk(queries, chunks, "chunk_uuid", "content", C.BRANCH_DEPTH)
        rows = chunks.join(top, "chunk_uuid").join(queries, "query_id")
        return rows.select(
            "query_id", F.col("rank").alias("pos"), "chunk_uuid", "content", "source_title",
            F.lit("local").alias("source_type"), F.lit(None).cast("string").alias("source_url"), "chunk_index",
            F.col("source").alias("retrieval_context"), "score",
            coverage(F.col("text"), F.col("content")).alias("rerank_score"),
        )

    return stored(spark, d, "candidates", ["documents", "benchmark"], build)


def site_text(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned pages, one table per version of the pages: cleaning is dear and several scans follow."""
    def build() -> DataFrame:
        title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
        return spread(table(spark, d, "pages"), "page_id").select(
            "page_id", "url", text.squeeze(text.decode_entities(title)).alias("title"),
            text.clean_html(F.col("html")).alias("content"),
        )

    return stored(spark, d, "site", ["pages"], build)


def web_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Best pages per benchmark passage in the shape a web search returns; one table per version of both."""
    def build() -> DataFrame:
        queries, site = queries_of(spark, d), site_text(spark, d)
        top = retrieval.bm25_topk(queries, site, "page_id", "content", WEB_RESULTS)
        rows = site.join(top, "page_id").join(queries, "query_id")
        return rows.select(
            "query_id", F.col("rank").alias("pos"), F.col("page_id").cast("string").alias("chunk_uuid"), "content",
            F.col("title").alias("source_title"), F.lit("web").alias("source_type"), F.col("url").alias("source_url"),
            F.lit(None).cast("int").alias("chunk_index"), F.lit("fallback").alias("retrieval_context"),
            F.round(F.col("score") / (F.col("score") + 10.0), 4).alias("score"),
            coverage(F.col("text"), F.col("content")).alias("rerank_score"),
        )

    return stored(spark, d, "web", ["pages", "benchmark"], build)


def refined_web(spark: SparkSession, d: str) -> DataFrame:
    return gate.refine_web(web_candidates(spark, d))
