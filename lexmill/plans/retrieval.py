"""Chunk building and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import sql as sql_functions
from ..functions import text
from ..operators import chunking, retrieval
from ..sources.store import stored
from ..sources.tables import materialize, table
from . import sql as S
from .candidates import chunks_of, docs_of, queries_of, windows_of
from .registry import query


def vectors_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vector stored for each benchmark passage, paired by id."""
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return vectors_of(spark, d).withColumnRenamed("id", "query_id").join(ids, "query_id")


@query("chunk_words", "WITH " + S.WINDOWS + """
SELECT doc_id, source AS source_title, chunk_index, length(content) AS chars, sha256(content) AS content_hash FROM windows""")
def chunk_words(spark, d):
    cut = chunking.chunk_words(docs_of(spark, d), "text", "source", ["doc_id"])
    return cut.select(
        "doc_id", "source_title", "chunk_index", F.length("content").cast("bigint").alias("chars"),
        F.sha2("content", 256).alias("content_hash"),
    )


@query("chunk_words_lateral", "WITH " + S.WINDOWS + """
SELECT doc_id, source AS source_title, chunk_index, length(content) AS chars, sha256(content) AS content_hash FROM windows""")
def chunk_words_lateral(spark, d):
    """The same windows through the table function, called from SQL."""
    sql_functions.register(spark)
    return spark.sql(
        "SELECT d.doc_id, d.source AS source_title, c.chunk_index, CAST(length(c.content) AS BIGINT) AS chars, sha2(c.content, 256) AS content_hash "
        "FROM {docs} d, LATERAL chunk_text(d.text, d.source) c", docs=docs_of(spark, d).select("doc_id", "source", "text"))


@query("chunk_build", "WITH " + S.CHUNKS + """
SELECT chunk_uuid, doc_id, chunk_index, source AS source_title, sha256(content) AS content_hash FROM chunks""")
def chunk_build(spark, d):
    return chunks_of(spark, d).select("chunk_uuid", "doc_id", "chunk_index", "source_title", "content_hash")


query("chunk_pipeline", "WITH " + S.CHUNKS + """
SELECT chunk_uuid, doc_id, chunk_index, source AS source_title, sha256(content) AS content_hash FROM chunks""")(chunk_build)


@query("drop_counts_by_reason", "WITH " + S.WINDOWS + f""",
judged AS (SELECT coalesce({S.drop_reason('content')}, 'kept') AS reason FROM windows)
SELECT coalesce(reason, 'generated') AS reason, count(*) AS n FROM judged GROUP BY GROUPING SETS ((reason), ())""")
def drop_counts_by_reason(spark, d):
    """Counted from the written windows, whose folders are the reasons: the texts are cut and judged once."""
    return (
        windows_of(spark, d).select("reason").rollup("reason").agg(F.count("*").alias("n"))
        .select(F.coalesce("reason", F.lit("generated")).alias("reason"), "n")
    )


@query("chunk_quality_filter", f"""
SELECT doc_id, ({S.drop_reason('text')}) IS NULL AS keep, {S.drop_reason('text')} AS reason FROM documents""")
def chunk_quality_filter(spark, d):
    reason = chunking.drop_reason(F.col("text"))
    return docs_of(spark, d).select("doc_id", reason.isNull().alias("keep"), reason.alias("reason"))




@query("section_split", f"""
WITH headed AS (SELECT doc_id, source, replace(replace(text, '. ', chr(10) || '== Gameplay ==' || chr(10)),
    '.' || chr(10), chr(10) || '=== References ===' || chr(10)) AS body FROM documents),
pieces AS (SELECT doc_id, unnest(string_split_regex(body, '(?m)^={{2,6}}[ \\t]*')) AS piece,
    generate_subscripts(string_split_regex(body, '(?m)^={{2,6}}[ \\t]*'), 1) - 1 AS idx FROM headed),
named AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx,
    CASE WHEN idx = 0 THEN 'Overview' ELSE trim(regexp_extract(piece, '^([^=\\n]+?)[ \\t]*={{2,6}}', 1)) END AS title,
    CASE WHEN idx = 0 THEN {S.strip('piece')}
         ELSE {S.strip("regexp_replace(piece, '^[^=\\n]+?[ \\t]*={2,6}[ \\t]*', '')")} END AS body FROM pieces)
SELECT doc_id, idx, title, length(body) AS chars, sha256(body) AS body_hash FROM named
WHERE body <> '' AND (idx = 0 OR lower(title) NOT IN ({S.strs(C.BOILERPLATE)}))""")
def section_split(spark, d):
    """Sentence ends of every document become headings, half of them boilerplate."""
    headed = F.replace("text", F.lit(". "), F.lit("\n== Gameplay ==\n"))
    headed = F.replace(headed, F.lit(".\n"), F.lit("\n=== References ===\n"))
    out = chunking.split_sections(docs_of(spark, d).select("doc_id", headed.alias("body")), "body", ["doc_id"])
    return out.select("doc_id", "idx", "title", F.length("body").cast("bigint").alias("chars"),
                      F.sha2("body", 256).alias("body_hash"))


@query("sparse_candidates_join", f"""
WITH {S.QUERIES}, terms AS (SELECT DISTINCT query_id, unnest({S.tokens('qtext')}) AS term FROM qry),
tok AS MATERIALIZED (SELECT doc_id, {S.tokens('text')} AS toks FROM documents),
post AS MATERIALIZED (SELECT doc_id, doc_len, term, CAST(count(*) AS INTEGER) AS tf FROM (
  SELECT doc_id, CAST(len(toks) AS INTEGER) AS doc_len, unnest(toks) AS term FROM tok) GROUP BY ALL)
SELECT query_id, doc_id, term, tf, doc_len FROM terms JOIN post USING (term)""")
def sparse_candidates_join(spark, d):
    found = retrieval.sparse_candidates(queries_of(spark, d), docs_of(spark, d), "doc_id", "text")
    return found.select("query_id", "doc_id", "term", "tf", "doc_len")


VECTORS = """
qv AS (SELECT b.item_id AS query_id, e.embedding::DOUBLE[] AS q FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
cos AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM qv, embeddings),
dtop AS (SELECT * FROM (SELECT query_id, id, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM cos) WHERE rank <= 20)"""


@query("dense_candidates_join", "WITH " + VECTORS + "SELECT query_id, id, score AS cosine FROM cos WHERE score >= 0.25")
def dense_candidates_join(spark, d):
    found = retrieval.dense_candidates(query_vectors(spark, d), vectors_of(spark, d), 0.25)
    return found.select("query_id", "id", F.col("score").alias("cosine"))


@query("dense_topk", "WITH " + VECTORS + "SELECT query_id, rank, id, score FROM dtop WHERE rank <= 10")
def dense_topk(spark, d):
    return retrieval.dense_topk(query_vectors(spark, d), vectors_of(spark, d), 10)


BANDS = 32
# the SQL counts, for every query and vector, how many of the query's least certain bits must be flipped
LSH = f"""
size AS (SELECT greatest(4, ceil(log2(greatest(count(*), 2)))::INTEGER - 3) AS bits FROM embeddings),
planes AS (SELECT p, bits, list(CASE WHEN ('0x' || substr(md5(p || ':' || i), 1, 1))::INTEGER < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) AS w
  FROM size, range({BANDS} * 64) AS a(p), range((SELECT max(len(embedding)) FROM embeddings)) AS b(i) WHERE p < {BANDS} * bits GROUP BY ALL),
dots AS MATERIALIZED (SELECT vec_id, p // bits AS band, p % bits AS bit, list_dot_product(embedding::DOUBLE[], w) AS dot FROM embeddings, planes),
doubts AS (SELECT vec_id AS query_id, band, bit, dot > 0 AS side,
    row_number() OVER (PARTITION BY vec_id, band ORDER BY round(abs(dot), 9), bit) AS nth
  FROM dots WHERE vec_id IN (SELECT query_id FROM qv)),
needs AS (SELECT query_id, v.vec_id AS id, band, max(CASE WHEN side <> (v.dot > 0) THEN nth ELSE 0 END) AS need
  FROM doubts JOIN dots v USING (band, bit) GROUP BY ALL),
need AS MATERIALIZED (SELECT query_id, id, min(need) AS need FROM needs GROUP BY ALL),
drawn AS (SELECT query_id FROM qv ORDER BY md5(query_id::VARCHAR), query_id LIMIT {retrieval.LSH_SAMPLE}),
counted AS (SELECT need, count(*) AS n FROM need JOIN dtop USING (query_id, id) WHERE rank <= 10 AND query_id IN (FROM drawn) GROUP BY need),
upto AS (SELECT need, sum(n) OVER (ORDER BY need) AS found, sum(n) OVER () AS total FROM counted),
flips AS (SELECT coalesce(min(need), 0) AS m FROM upto WHERE found >= {retrieval.LSH_TARGET} * total),
met AS MATERIALIZED (SELECT query_id, id FROM need, flips WHERE need <= m),
sizes AS (SELECT query_id, count(*) AS met FROM met GROUP BY query_id),
near AS (SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM met JOIN cos USING (query_id, id)) WHERE rank <= 10),
hit AS (SELECT query_id, round(count(*) / 10, 4) AS recall FROM near JOIN (SELECT query_id, id FROM dtop WHERE rank <= 10) USING (query_id, id) GROUP BY 1)
SELECT qv.query_id, near.rank, near.id, near.score, coalesce(met, 0) AS met, coalesce(recall, 0) AS recall
FROM qv LEFT JOIN near USING (query_id) LEFT JOIN sizes USING (query_id) LEFT JOIN hit USING (query_id)"""


@query("dense_topk_lsh", "WITH " + VECTORS + "," + LSH)
def dense_topk_lsh(spark, d):
    """Approximate search with the pairs it scored and its recall against the exact one; a query without candidates has recall 0."""
    vectors, queries = vectors_of(spark, d), query_vectors(spark, d)
    dim = vectors.select(F.size("vec")).first()[0]
    exact = retrieval.dense_topk(queries, vectors, 10).select("query_id", "id", F.lit(1).alias("hit"))
    near = materialize(retrieval.dense_topk_lsh(queries, vectors, 10, dim, BANDS), "lsh")
    found = near.join(exact, ["query_id", "id"], "left")
    recall = found.groupBy("query_id").agg(F.round(F.count("hit") / 10, 4).alias("recall"))
    rows = queries.select("query_id").join(near, "query_id", "left").join(recall, "query_id", "left")
    return rows.select("query_id", "rank", "id", "score", F.coalesce("met", F.lit(0).cast("bigint")).alias("met"),
                       F.coalesce("recall", F.lit(0.0)).alias("recall"))


BM25_CHUNKS = "WITH " + S.CHUNKS + ", " + S.QUERIES + "," + S.bm25("c", "chunks", "chunk_uuid", "content", 5)
BM25_DOCS = S.QUERIES + "," + S.bm25("b", "documents", "doc_id", "text", 20)


@query("bm25_topk", BM25_CHUNKS + " SELECT query_id, rank, chunk_uuid, score FROM c_top")
def bm25_topk(spark, d):
    return retrieval.bm25_topk(queries_of(spark, d), chunks_of(spark, d), "chunk_uuid", "content", 5)


def sparse_list(spark, d) -> DataFrame:
    """The sparse branch, one table per version of documents and questions."""
    def build() -> DataFrame:
        found = retrieval.bm25_topk(queries_of(spark, d), docs_of(spark, d), "doc_id", "text", C.BRANCH_DEPTH)
        return found.withColumnRenamed("doc_id", "id")

    return stored(spark, d, "sparse", ["documents", "benchmark"], build)


def dense_list(spark, d) -> DataFrame:
    """The dense branch, one table per version of vectors and questions."""
    return stored(spark, d, "dense", ["embeddings", "benchmark"],
                  lambda: retrieval.dense_topk(query_vectors(spark, d), vectors_of(spark, d), C.BRANCH_DEPTH))


def fused_sql(limit: int) -> str:
    return f"""
fused AS (SELECT query_id, id, round(sum(1.0 / ({C.RRF_K} + rank)), 8) AS score FROM (
  SELECT query_id, doc_id AS id, rank FROM b_top UNION ALL SELECT query_id, id, rank FROM dtop) GROUP BY query_id, id),
ftop AS (SELECT * FROM (SELECT query_id, id, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused) WHERE rank <= {limit})"""


LIMIT = 5
FETCH = max(C.FETCH_FACTOR * LIMIT, 20)


@query("rrf_fusion", "WITH " + BM25_DOCS + "," + VECTORS + "," + fused_sql(FETCH) + " SELECT query_id, rank, id, score FROM ftop")
def rrf_fusion(spark, d):
    return retrieval.rrf([sparse_list(spark, d), dense_list(spark, d)], "id", FETCH)


def reranked(spark, d, fused: DataFrame) -> DataFrame:
    """Fused rows with the tokens of both sides, rescored and cut."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    terms = queries_of(spark, d).select("query_id", text.word_tokens(F.col("text")).alias("q_toks"))
    # only the texts of fused rows are cut into tokens
    met = docs.join(fused, "id").withColumn("c_toks", text.word_tokens(F.col("text"))).drop("text")
    return retrieval.rerank(met.join(terms, "query_id"), "id", "q_toks", "c_toks", LIMIT)


RERANKED = f""",
raw AS (SELECT f.*, {S.coverage('q.qtext', 'd.text')} AS raw FROM ftop f JOIN documents d ON d.doc_id = f.id JOIN qry q USING (query_id)),
whole AS (SELECT *, CASE WHEN bool_and(raw IS NOT NULL) OVER (PARTITION BY query_id) THEN raw END AS rerank_score FROM raw),
rtop AS (SELECT * FROM (SELECT query_id, id, score, rerank_score, CAST(row_number() OVER (
  PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank, id) AS INTEGER) AS rank FROM whole) WHERE rank <= {LIMIT})"""


@query("rerank_topk", "WITH " + BM25_DOCS + "," + VECTORS + "," + fused_sql(FETCH) + RERANKED
       + " SELECT query_id, rank, id, score, rerank_score FROM rtop")
def rerank_topk(spark, d):
    fused = retrieval.rrf([sparse_list(spark, d), dense_list(spark, d)], "id", FETCH)
    return reranked(spark, d, fused)


MODES_SQL = "WITH " + BM25_DOCS + "," + VECTORS + "," + fused_sql(FETCH) + RERANKED + f"""
SELECT 'dense' AS mode, query_id, rank, id FROM dtop WHERE rank <= {LIMIT}
UNION ALL SELECT 'bm25', query_id, rank, doc_id FROM b_top WHERE rank <= {LIMIT}
UNION ALL SELECT 'hybrid', query_id, rank, id FROM ftop WHERE rank <= {LIMIT}
UNION ALL SELECT 'hybrid_rerank', query_id, rank, id FROM rtop"""


def modes(spark, d) -> DataFrame:
    """Every mode's result list in one table; the two branches are computed once each."""
    sparse, dense = sparse_list(spark, d), dense_list(spark, d)
    fused = retrieval.rrf([sparse, dense], "id", FETCH)
    lists = {"dense": dense, "bm25": sparse, "hybrid": fused, "hybrid_rerank": reranked(spark, d, fused)}
    out = None
    for mode, rows in lists.items():
        part = rows.where(F.col("rank") <= LIMIT).select(F.lit(mode).alias("mode"), "query_id", "rank", "id")
        out = part if out is None else out.unionByName(part)
    return out


query("retrieval_modes", MODES_SQL)(modes)
