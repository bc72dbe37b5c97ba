"""Column layouts of the input tables and of the shared intermediate tables."""

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
EMBEDDINGS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"
CHUNKS = (
    "chunk_uuid STRING, doc_id BIGINT, parent_id STRING, chunk_index INT, source STRING, "
    "content_type STRING, source_title STRING, content STRING, content_hash STRING"
)
CANDIDATES = (
    "query_id BIGINT, pos INT, chunk_uuid STRING, content STRING, source_title STRING, "
    "source_type STRING, source_url STRING, chunk_index INT, retrieval_context STRING, "
    "score DOUBLE, rerank_score DOUBLE"
)
EVENT_PROPS = "k BIGINT"
