"""De-duplication, ordering and packing queries over candidate lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text
from ..functions.numbers import rounded
from ..operators import context, similarity
from ..sources.tables import materialize, spread, table
from . import sql as S
from .candidates import local_candidates, refined_web, web_candidates
from .registry import query

Q = ["query_id"]
TASKS = ["comparison", "listicle", "factual"]

REL = """CASE WHEN bool_and(rerank_score IS NOT NULL) OVER (PARTITION BY {g}) THEN rerank_score ELSE coalesce(score, 0.0) END"""


def relevance_sql(rows: str, g: str) -> str:
    return f"""(SELECT *, CAST(row_number() OVER (PARTITION BY {g} ORDER BY rel DESC, pos) AS INTEGER) AS rank
  FROM (SELECT *, {REL.format(g=g)} AS rel FROM {rows}))"""


def comparison_sql(rows: str, g: str) -> str:
    return f"""(SELECT *, CAST(row_number() OVER (PARTITION BY {g} ORDER BY band, CASE WHEN band = 0 THEN seen ELSE 0 END,
    CASE WHEN band = 0 THEN 0 ELSE -rel END, CASE WHEN band = 2 THEN seen ELSE 0 END, nth, pos) AS INTEGER) AS rank
  FROM (SELECT *, CASE WHEN entity IS NULL THEN 1 WHEN nth = 1 THEN 0 ELSE 2 END AS band FROM (
    SELECT *, row_number() OVER (PARTITION BY {g}, entity ORDER BY rel DESC, pos) AS nth, min(pos) OVER (PARTITION BY {g}, entity) AS seen
    FROM (SELECT *, {REL.format(g=g)} AS rel, CASE WHEN retrieval_context NOT IN ('', 'fallback') THEN retrieval_context END AS entity FROM {rows}))))"""


def list_sql(rows: str, g: str) -> str:
    return f"""(SELECT *, CAST(row_number() OVER (PARTITION BY {g} ORDER BY indexed DESC, CASE WHEN indexed THEN chunk_index END NULLS LAST,
    CASE WHEN indexed THEN 0 ELSE -rel END, pos) AS INTEGER) AS rank
  FROM (SELECT *, {REL.format(g=g + ', indexed')} AS rel FROM (SELECT *, coalesce(chunk_index >= 0, FALSE) AS indexed FROM {rows})))"""


def dedupe_sql(rows: str) -> str:
    return f"""(SELECT * EXCLUDE (pos, k, n, first_pos), first_pos AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY length(content) DESC, pos) AS n, min(pos) OVER (PARTITION BY query_id, k) AS first_pos
    FROM (SELECT *, concat(source_title, '::', array_to_string({S.compare_tokens('content')}, ' ')) AS k FROM {rows} WHERE {S.strip('content')} <> '')) WHERE n = 1)"""


def uncontained_sql(rows: str) -> str:
    return f"""(SELECT * FROM {rows} a WHERE NOT EXISTS (SELECT 1 FROM {rows} b WHERE b.query_id = a.query_id AND b.source_type = a.source_type
    AND length(b.content) > length(a.content) AND contains(b.content, a.content)))"""


def merged(spark, d):
    """Local rows followed by the web rows kept for the same query."""
    web = refined_web(spark, d).withColumn("pos", F.col("pos") + C.BRANCH_DEPTH)
    return local_candidates(spark, d).unionByName(web)


MERGED = S.BOTH + f", merged AS MATERIALIZED (SELECT * FROM local UNION ALL BY NAME SELECT * REPLACE (pos + {C.BRANCH_DEPTH} AS pos) FROM refined)"


@query("merge_dedupe_first", MERGED + """
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g, p) AS INTEGER) AS pos, sha256(content) AS content_hash FROM (
  SELECT query_id, content, min(g) AS g, arg_min(pos, (g, pos)) AS p FROM (
    SELECT query_id, pos, content, 0 AS g FROM local UNION ALL SELECT query_id, pos, content, 1 FROM refined UNION ALL SELECT query_id, pos, content, 2 FROM web) GROUP BY ALL)""")
def merge_dedupe_first(spark, d):
    groups = [local_candidates(spark, d), refined_web(spark, d), web_candidates(spark, d)]
    out = context.merge_first([g.select("query_id", "pos", "content") for g in groups])
    return out.select("query_id", "pos", F.sha2("content", 256).alias("content_hash"))


@query("normalized_dedup_longest", MERGED + f" SELECT query_id, pos, chunk_uuid, sha256(content) AS content_hash FROM {dedupe_sql('merged')}")
def normalized_dedup_longest(spark, d):
    out = context.dedupe_longest(merged(spark, d), Q)
    return out.select("query_id", "pos", "chunk_uuid", F.sha2("content", 256).alias("content_hash"))


@query("substring_containment", MERGED + f" SELECT query_id, pos, chunk_uuid FROM {uncontained_sql('merged')}")
def substring_containment(spark, d):
    return context.drop_contained(merged(spark, d), Q).select("query_id", "pos", "chunk_uuid")


@query("relevance_order", MERGED + f" SELECT query_id, rank, chunk_uuid FROM {relevance_sql('merged', 'query_id')}")
def relevance_order(spark, d):
    return context.relevance_order(merged(spark, d), Q).select("query_id", "rank", "chunk_uuid")


@query("comparison_order", MERGED + f" SELECT query_id, rank, chunk_uuid FROM {comparison_sql('merged', 'query_id')}")
def comparison_order(spark, d):
    return context.comparison_order(merged(spark, d), Q).select("query_id", "rank", "chunk_uuid")


@query("list_order", MERGED + f" SELECT query_id, rank, chunk_uuid FROM {list_sql('merged', 'query_id')}")
def list_order(spark, d):
    return context.list_order(merged(spark, d), Q).select("query_id", "rank", "chunk_uuid")


@query("jaccard_candidate_pairs", MERGED + f""",
t AS MATERIALIZED (SELECT query_id, pos, chunk_uuid, list_distinct({S.compare_tokens('content')}) AS toks FROM merged)
SELECT a.query_id, a.chunk_uuid AS id_a, b.chunk_uuid AS id_b,
  round(len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))), 6) AS jaccard
FROM t a JOIN t b ON a.query_id = b.query_id AND a.pos < b.pos
WHERE len(list_intersect(a.toks, b.toks)) >= {C.JACCARD_LIMIT} * len(list_distinct(list_concat(a.toks, b.toks)))""")
def jaccard_candidate_pairs(spark, d):
    """The pairwise test inside each query's candidate list."""
    return context.near_duplicates(merged(spark, d))


# every pair of different token sets, counted token by token: no prefix, no bound
ALL_SETS = f"""
WITH sets AS MATERIALIZED (SELECT doc_id, coalesce(list_sort(list_distinct({S.compare_tokens('text')})), []) AS toks FROM documents),
classes AS MATERIALIZED (SELECT toks, min(doc_id) AS class_id, count(*) AS members FROM sets GROUP BY toks),
each AS MATERIALIZED (SELECT class_id, len(toks) AS n, unnest(toks) AS token FROM classes),
met AS (SELECT a.class_id AS class_a, b.class_id AS class_b, a.n, b.n AS m, count(*) AS shared
  FROM each a JOIN each b ON a.token = b.token AND a.class_id < b.class_id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT class_a, class_b, round(shared / (n + m - shared), 6) AS jaccard FROM met WHERE shared >= {C.JACCARD_LIMIT} * (n + m - shared))"""


def near_dup_sets(spark, d):
    # texts are read once and cut by Spark from 4 MB a core on, so only a smaller table is shuffled
    docs = spread(table(spark, d, "documents"), "doc_id", split=4 << 20)
    return similarity.similarity_classes(docs, "doc_id", text.compare_set(F.col("text")), C.JACCARD_LIMIT)


@query("jaccard_near_dup_pairs", ALL_SETS + " SELECT class_a AS id_a, class_b AS id_b, jaccard FROM pairs")
def jaccard_near_dup_pairs(spark, d):
    """All pairs of different texts, corpus wide; equal token sets are named by their smallest id."""
    pairs, _ = near_dup_sets(spark, d)
    return pairs.select(F.col("class_a").alias("id_a"), F.col("class_b").alias("id_b"), rounded(F.col("jaccard"), 6).alias("jaccard"))


@query("jaccard_near_dup_classes", ALL_SETS + """,
ends AS (SELECT class_a AS class_id, jaccard FROM pairs UNION ALL SELECT class_b, jaccard FROM pairs),
links AS (SELECT class_id, count(*) AS links, max(jaccard) AS best_jaccard FROM ends GROUP BY class_id)
SELECT doc_id, class_id, members, coalesce(links, 0) AS links, best_jaccard
FROM sets JOIN classes USING (toks) LEFT JOIN links USING (class_id)""")
def jaccard_near_dup_classes(spark, d):
    """Per document: its class of equal token sets, how many it holds, how many other sets it links to, the best link."""
    _, members = near_dup_sets(spark, d)
    return members.withColumn("best_jaccard", rounded(F.col("best_jaccard"), 6))


def pack_sql(ordered: str, cap: int = C.CONTEXT_CHARS) -> str:
    """Recursive fold over rows (g, rank, chunk_uuid, content) of ``ordered``; ends in CTE packed."""
    return f"""
items AS MATERIALIZED (SELECT g, rank, chunk_uuid, length({S.strip('content')}) AS chars, list_distinct({S.compare_tokens('content')}) AS toks FROM {ordered}),
fold AS (
  SELECT g, 0 AS rank, 0::BIGINT AS used, 0 AS redundant, []::STRUCT(chunk_uuid VARCHAR, used BIGINT, toks VARCHAR[])[] AS kept FROM (SELECT DISTINCT g FROM items)
  UNION ALL
  SELECT f.g, i.rank, CASE WHEN i.over OR i.same THEN f.used ELSE f.used + i.chars END,
    f.redundant + CASE WHEN NOT i.over AND i.same THEN 1 ELSE 0 END,
    CASE WHEN i.over OR i.same THEN f.kept ELSE list_append(f.kept, {{'chunk_uuid': i.chunk_uuid, 'used': f.used + i.chars, 'toks': i.toks}}) END
  FROM fold f, LATERAL (SELECT x.rank, x.chunk_uuid, x.chars, x.toks, x.chars = 0 OR f.used + x.chars > {cap} AS over,
      len(x.toks) = 0 OR len(list_filter(f.kept, lambda k: len(list_intersect(k.toks, x.toks)) >= {C.JACCARD_LIMIT} * len(list_distinct(list_concat(k.toks, x.toks))))) > 0 AS same
    FROM items x WHERE x.g = f.g AND x.rank = f.rank + 1) i),
packed AS MATERIALIZED (SELECT g, arg_max(used, rank) AS used, arg_max(redundant, rank) AS redundant, arg_max(kept, rank) AS kept, max(rank) AS n_in FROM fold GROUP BY g)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query("budget_pack", recursive(MERGED) + f", ranked AS (SELECT query_id AS g, * FROM {relevance_sql('merged', 'query_id')})," + pack_sql("ranked") + """
SELECT g AS query_id, CAST(generate_subscripts(kept, 1) AS INTEGER) AS rank, unnest(kept).chunk_uuid AS chunk_uuid,
  CAST(unnest(kept).used AS INTEGER) AS used_chars, redundant FROM packed""")
def budget_pack(spark, d):
    ordered = context.relevance_order(merged(spark, d), Q)
    return context.packed_rows(context.budget_pack(ordered, Q), Q)


def assembled(rows):
    """De-duplicate once, then order and pack each query for every task."""
    unique = materialize(context.drop_contained(context.dedupe_longest(rows, Q), Q), "unique")
    orders = {"comparison": context.comparison_order, "listicle": context.list_order, "factual": context.relevance_order}
    out = None
    for task in TASKS:
        part = orders[task](unique, Q).withColumn("task", F.lit(task)).select("task", "query_id", "rank", "chunk_uuid", "content")
        out = part if out is None else out.unionByName(part)
    return context.budget_pack(out, ["task", "query_id"])


ASSEMBLED = recursive(MERGED) + f""",
deduped AS MATERIALIZED (SELECT * FROM {dedupe_sql('merged')}),
uniq AS MATERIALIZED (SELECT * FROM {uncontained_sql('deduped')}),
ranked AS MATERIALIZED (
  SELECT 'comparison:' || query_id AS g, rank, chunk_uuid, content FROM {comparison_sql('uniq', 'query_id')}
  UNION ALL SELECT 'listicle:' || query_id, rank, chunk_uuid, content FROM {list_sql('uniq', 'query_id')}
  UNION ALL SELECT 'factual:' || query_id, rank, chunk_uuid, content FROM {relevance_sql('uniq', 'query_id')}),""" + pack_sql("ranked") + """,
parted AS (SELECT split_part(g, ':', 1) AS task, CAST(split_part(g, ':', 2) AS BIGINT) AS query_id, * FROM packed)"""


@query("context_assembly", ASSEMBLED + """
SELECT task, query_id, CAST(generate_subscripts(kept, 1) AS INTEGER) AS rank, unnest(kept).chunk_uuid AS chunk_uuid,
  CAST(unnest(kept).used AS INTEGER) AS used_chars, redundant FROM parted""")
def context_assembly(spark, d):
    return context.packed_rows(assembled(merged(spark, d)), ["task", "query_id"])


@query("compression_ratio", ASSEMBLED + """,
s AS (SELECT task, sum(n_in) AS deduped, sum(len(kept)) AS final, sum(redundant) AS redundant FROM parted GROUP BY task),
i AS (SELECT count(*) AS initial FROM merged)
SELECT task, initial, CAST(final AS BIGINT) AS final, round(greatest(0.0, (initial - final) / initial), 4) AS ratio,
  round(100.0 * redundant / deduped, 2) AS redundancy_rate FROM s, i""")
def compression_ratio(spark, d):
    """Rows removed between the merged lists and the packed context, per task."""
    rows = merged(spark, d)
    initial = rows.agg(F.count("*")).scalar()
    per = assembled(rows).groupBy("task").agg(
        F.sum("n_in").alias("deduped"), F.sum(F.size("kept")).alias("final"), F.sum("redundant").alias("redundant"))
    per = per.withColumn("initial", initial)
    ratio = F.greatest(F.lit(0.0), (F.col("initial") - F.col("final")) / F.col("initial"))
    return per.select(
        "task", "initial", "final", rounded(F.when(F.col("initial") > 0, ratio).otherwise(0.0), 4).alias("ratio"),
        rounded(F.when(F.col("deduped") > 0, 100.0 * F.col("redundant") / F.col("deduped")).otherwise(0.0), 2).alias("redundancy_rate"))


VERBOSE, CONCISE, LABEL = 900, 400, 24


@query("prompt_budget_ladder", ASSEMBLED + f""",
k AS (SELECT task, query_id, generate_subscripts(kept, 1) AS rank, unnest(kept).used AS used FROM parted),
per AS (SELECT task, query_id, coalesce(max(used + rank * {LABEL}), 0) AS total, count(rank) AS n, count(*) FILTER (used + rank * {LABEL} + {CONCISE} <= {C.PROMPT_CHARS}) AS fits
  FROM (SELECT DISTINCT task, query_id FROM parted) LEFT JOIN k USING (task, query_id) GROUP BY ALL),
m AS (SELECT task, CASE WHEN total + {VERBOSE} <= {C.PROMPT_CHARS} THEN 'verbose' WHEN total + {CONCISE} <= {C.PROMPT_CHARS} THEN 'concise' WHEN {CONCISE} <= {C.PROMPT_CHARS} THEN 'truncated' ELSE 'minimal' END AS mode, n, fits FROM per)
SELECT task, mode, count(*) AS n, CAST(sum(CASE WHEN mode IN ('verbose', 'concise') THEN n ELSE fits END) AS BIGINT) AS chunks_used FROM m GROUP BY ALL""")
def prompt_budget_ladder(spark, d):
    """How many packed contexts fit which wording; LABEL characters frame each chunk."""
    kept = assembled(merged(spark, d)).select("task", "query_id", F.posexplode_outer("kept").alias("n", "k"))
    before = F.col("k.used")
    sized = kept.select("task", "query_id", (F.col("n") + 1).alias("rank"), before.alias("used"))
    from pyspark.sql import Window

    prior = F.coalesce(F.lag("used").over(Window.partitionBy("task", "query_id").orderBy("rank")), F.lit(0))
    sized = sized.withColumn("chars", F.col("used") - prior + LABEL)
    modes = context.prompt_ladder(sized, ["task", "query_id"], "chars", VERBOSE, CONCISE)
    return modes.groupBy("task", "mode").agg(F.count("*").alias("n"), F.sum("chunks_used").alias("chunks_used"))
