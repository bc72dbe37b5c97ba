"""Routed retrieval: questions of several kinds over the chunk store, decomposed and limited by their intent."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import context, gate, routing
from ..sources.store import stored
from ..sources.tables import table
from . import sql as S
from .candidates import chunks_of, refined_web
from .gating import CUT, OPENING, graded, sql_signals, verdict_sql
from .packing import comparison_sql
from .registry import query

KINDS = 3

# every benchmark passage is asked about, listed, and compared with the next one
ASKED_SQL = f"""
asked AS (SELECT a.item_id * {KINDS} AS query_id, 'What is ' || a.text AS text FROM benchmark a
  UNION ALL SELECT a.item_id * {KINDS} + 1, 'The best list of ' || a.text FROM benchmark a
  UNION ALL SELECT a.item_id * {KINDS} + 2, a.text || ' vs ' || b.text FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
signed AS (SELECT *, {sql_signals('text')} AS signals FROM asked),
tasked AS (SELECT *, CASE WHEN list_contains(signals, 'comparison') THEN 'comparison' WHEN list_contains(signals, 'listicle') THEN 'listicle'
  WHEN list_contains(signals, 'factual') THEN 'factual' ELSE 'open' END AS task FROM signed),
routes AS MATERIALIZED (SELECT *, CASE WHEN task = 'listicle' THEN 10 WHEN task = 'factual' AND len(signals) > 1 THEN 7 ELSE 5 END AS n,
  task = 'open' OR list_contains(signals, 'temporal') AS web FROM tasked),
cuts AS (SELECT *, {S.strip(f"regexp_extract(text, '{CUT}', 1)")} AS l, {S.strip(f"regexp_extract(text, '{CUT}', 3)")} AS r FROM routes),
parts AS MATERIALIZED (
  SELECT query_id, task, n, 0 AS part_no, CASE WHEN task = 'comparison' AND l <> '' AND r <> '' THEN l ELSE text END AS sub_query FROM cuts
  UNION ALL SELECT query_id, task, n, 1, r FROM cuts WHERE task = 'comparison' AND l <> '' AND r <> ''),
pqry AS (SELECT query_id * 2 + part_no AS query_id, sub_query AS qtext FROM parts),
qry AS (SELECT query_id, text AS qtext FROM routes)"""

ROUTED = "WITH " + S.CHUNKS + "," + ASKED_SQL + "," + S.bm25("r", "chunks", "chunk_uuid", "content", 10).replace("FROM qry", "FROM pqry") + f""",
found AS (SELECT p.query_id, p.task, p.part_no, t.rank, t.chunk_uuid, c.content, c.source AS source_title, 'local' AS source_type,
    CAST(NULL AS VARCHAR) AS source_url, c.chunk_index, CASE WHEN p.task = 'comparison' THEN p.sub_query END AS retrieval_context, t.score,
    {S.coverage('p.sub_query', 'c.content')} AS rerank_score
  FROM r_top t JOIN parts p ON p.query_id * 2 + p.part_no = t.query_id JOIN chunks c USING (chunk_uuid) WHERE t.rank <= p.n),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY part_no, rank) AS nth FROM found) WHERE nth = 1),
routed AS MATERIALIZED (SELECT * EXCLUDE (nth, part_no, rank), CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY CASE WHEN task = 'listicle' THEN coalesce(chunk_index, 0) ELSE 0 END, part_no, rank) AS INTEGER) AS pos FROM firsts)"""


def questions(spark, d):
    items = table(spark, d, "benchmark").select("item_id", "text")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    base = F.col("item_id") * KINDS
    plain = items.select(base.alias("query_id"), F.concat(F.lit("What is "), "text").alias("text"))
    listed = items.select((base + 1).alias("query_id"), F.concat(F.lit("The best list of "), "text").alias("text"))
    compared = items.join(after, "item_id").select((base + 2).alias("query_id"), F.concat("text", F.lit(" vs "), "other").alias("text"))
    return plain.unionByName(listed).unionByName(compared)


def routed_of(spark, d):
    """(routes, candidates), one table each per version of documents and questions."""
    asked = stored(spark, d, "routes", ["benchmark"], lambda: routing.routed(questions(spark, d)))
    rows = stored(spark, d, "routed", ["documents", "benchmark"], lambda: routing.routed_candidates(asked, chunks_of(spark, d)))
    return asked, rows


@query("routed_retrieval", ROUTED + """
SELECT query_id, task, pos, chunk_uuid, sha256(retrieval_context) AS context_hash, score, rerank_score FROM routed""")
def routed_retrieval(spark, d):
    _, rows = routed_of(spark, d)
    return rows.select("query_id", "task", "pos", "chunk_uuid", F.sha2("retrieval_context", 256).alias("context_hash"), "score", "rerank_score")


BALANCE = """
per AS (SELECT query_id, coalesce(nullif(retrieval_context, ''), nullif(source_title, '')) AS entity, count(*) AS c FROM routed GROUP BY ALL),
bal AS (SELECT query_id, count(*) AS entities, max(c) AS max_n, min(c) AS min_n, count(*) < 2 OR max(c) > 3 * min(c) AS unbalanced
  FROM per WHERE entity IS NOT NULL GROUP BY query_id)"""


@query("routed_entity_balance", ROUTED + "," + BALANCE + " SELECT * FROM bal")
def routed_entity_balance(spark, d):
    """Entities of a comparison are its parts."""
    return gate.entity_balance(routed_of(spark, d)[1])


@query("routed_comparison_order", ROUTED + ", compared AS (SELECT * FROM routed WHERE task = 'comparison')"
       + f" SELECT query_id, rank, chunk_uuid FROM {comparison_sql('compared', 'query_id')}")
def routed_comparison_order(spark, d):
    compared = routed_of(spark, d)[1].where("task = 'comparison'")
    return context.comparison_order(compared, ["query_id"]).select("query_id", "rank", "chunk_uuid")


@query("routed_capability", ROUTED + "," + OPENING + "," + verdict_sql("routed", "v") + "," + BALANCE + """,
j AS (SELECT v.query_id, r.task, status, reason, evidence_count, list_contains(signals, 'comparison') AS cmp,
    list_contains(signals, 'temporal') AND NOT temporal AS stale, entities, unbalanced
  FROM v JOIN routes r USING (query_id) LEFT JOIN bal USING (query_id) WHERE provider = 'local'),
k AS (SELECT *, cmp AND coalesce(entities, 0) < 2 AS narrow, cmp AND coalesce(unbalanced, TRUE) AS lop FROM j)
SELECT query_id, task AS asked, CASE WHEN status = 'quality_empty' OR narrow THEN 'insufficient' WHEN status = 'quality_weak' OR lop OR stale THEN 'partial' ELSE 'full' END AS capability,
  CASE WHEN evidence_count = 0 THEN 'no_evidence' WHEN status = 'quality_empty' THEN 'quality_empty:' || reason WHEN narrow THEN 'comparison_entity_coverage' WHEN stale THEN 'no_temporal_evidence'
    WHEN lop THEN 'unbalanced_entities' WHEN status = 'quality_weak' THEN 'weak_evidence' ELSE 'sufficient' END AS reason FROM k""")
def routed_capability(spark, d):
    """What the evidence of each question allows, with the signals it really has."""
    asked, rows = routed_of(spark, d)
    verdict = graded(spark, d, rows.drop("task"), ["local"], asked.select("query_id", "text"))
    return gate.capability(asked.select("query_id", F.col("task").alias("asked"), "signals"), verdict, gate.entity_balance(rows))


@query("routed_web_merge", ROUTED + "," + OPENING + ", bqry AS (SELECT item_id AS query_id, text AS qtext FROM benchmark)," + S.WEB_PARTS.lstrip().lstrip(",").replace("FROM qry", "FROM bqry").replace("JOIN qry", "JOIN bqry") + f""",
mweb AS (SELECT r.query_id, w.* EXCLUDE (query_id) FROM routes r JOIN refined w ON w.query_id = r.query_id // {KINDS}),
both_rows AS (SELECT * FROM routed UNION ALL BY NAME SELECT * REPLACE (pos + {C.BRANCH_DEPTH} AS pos) FROM mweb),"""
       + verdict_sql("routed", "v") + "," + verdict_sql("both_rows", "m") + """,
j AS (SELECT v.query_id, v.status AS b, m.status AS a, v.status <> 'quality_ok' OR (r.web AND v.temporal) AS asks,
  v.query_id IN (SELECT query_id FROM mweb) AS has FROM v JOIN m USING (query_id, provider) JOIN routes r USING (query_id) WHERE v.provider = 'local')
SELECT query_id, CASE WHEN asks AND has THEN 'LOCAL_PLUS_WEB' WHEN asks THEN 'LOCAL_WEB_ATTEMPTED' ELSE 'LOCAL_ONLY' END AS merge_state,
  b AS status_before, CASE WHEN asks AND has THEN a ELSE b END AS status_after FROM j""")
def routed_web_merge(spark, d):
    """Web rows of the passage a question is about join its routed rows, and the verdict is taken again."""
    asked, rows = routed_of(spark, d)
    queries = asked.select("query_id", "text")
    passage = asked.select("query_id", F.floor(F.col("query_id") / KINDS).alias("passage"))
    web = refined_web(spark, d).withColumnRenamed("query_id", "passage").join(passage, "passage").drop("passage")
    web = web.withColumn("pos", F.col("pos") + C.BRANCH_DEPTH)
    local = rows.drop("task")
    before = graded(spark, d, local, ["local"], queries)
    after = graded(spark, d, local.unionByName(web), ["local"], queries)
    return gate.web_merge(before, asked.select("query_id", "web"), web, after)
