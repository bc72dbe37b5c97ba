"""Stream queries, run over the files that are there and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams
from . import sql as S
from .evaluation import EVENTS
from .registry import query


@query("stream_ingest_chunks", "WITH " + S.CHUNKS + "SELECT chunk_uuid, doc_id, chunk_index, source AS source_title, sha256(content) AS content_hash FROM chunks")
def stream_ingest_chunks(spark, d):
    return streams.stream_ingest_chunks(spark, d).select("chunk_uuid", "doc_id", "chunk_index", "source_title", "content_hash")


@query("stream_usage_daily", "WITH " + EVENTS + """
SELECT day, provider, surface, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(*) FILTER (fallback) AS fallbacks
FROM usage GROUP BY 1, 2, 3""")
def stream_usage_daily(spark, d):
    return streams.stream_usage_daily(spark, d)


def windows_sql(kind: str, hops: int) -> str:
    return f"""SELECT '{kind}' AS kind, strftime(start, '%Y-%m-%d %H:%M') AS window_start, event_type AS name, count(*) AS n, round(avg(value), 6) AS "avg", min(value) AS "min", max(value) AS "max"
FROM (SELECT *, time_bucket(INTERVAL '{12 // hops} hours', ts) - INTERVAL (h * {12 // hops}) HOUR AS start FROM events, range({hops}) AS r(h)) GROUP BY ALL"""


@query("stream_latency_windows", windows_sql("tumbling", 1) + " UNION ALL " + windows_sql("sliding", 2))
def stream_latency_windows(spark, d):
    return streams.stream_latency_windows(spark, d)


@query("stream_dim_refresh", """
SELECT event_id, event_type, k AS p_partkey, p_name FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) LEFT JOIN part ON p_partkey = k AND p_size > 10""")
def stream_dim_refresh(spark, d):
    return streams.stream_dim_refresh(spark, d)
