"""Signals, grounding, verdict and capability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text
from ..functions.numbers import rounded
from ..operators import gate
from ..sources.tables import spread, table
from . import sql as S
from .candidates import local_candidates, queries_of, refined_web, web_candidates
from .registry import query


@query("noise_flag", f"""
WITH h AS (SELECT doc_id, {S.noise_hits('source')} AS src, {S.noise_hits('text')} AS body FROM documents)
SELECT doc_id, len(src) > 0 OR len(body) >= {C.NOISE_DENSITY} AS flag,
  CASE WHEN len(src) > 0 THEN 'source_match' WHEN len(body) >= {C.NOISE_DENSITY} THEN 'content_density' END AS reason,
  CASE WHEN len(src) > 0 THEN array_to_string(src, ',') WHEN len(body) >= {C.NOISE_DENSITY} THEN array_to_string(body, ',') ELSE '' END AS kws
FROM h""")
def noise_flag(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    hits = docs.select("doc_id", text.noise_hits(F.col("source")).alias("src"), text.noise_hits(F.col("text")).alias("body"))
    reason = F.when(F.size("src") > 0, "source_match").when(F.size("body") >= C.NOISE_DENSITY, "content_density")
    kws = F.when(reason == "source_match", F.col("src")).when(reason == "content_density", F.col("body")).otherwise(F.array().cast("array<string>"))
    return hits.select("doc_id", reason.isNotNull().alias("flag"), reason.alias("reason"), F.array_join(kws, ",").alias("kws"))


@query("temporal_flag", f"SELECT doc_id, {S.temporal(chr(39).join(['concat_ws(', ' ', ', source, text)']))} AS temporal FROM documents")
def temporal_flag(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    return docs.select("doc_id", text.is_temporal(F.concat_ws(" ", "source", "text")).alias("temporal"))


@query("noise_rule_comparison", f"""
WITH h AS (SELECT page_id, {S.noise_hits("concat_ws(' ', title, content)")} AS old, {S.noise_hits("concat_ws(' ', title, url)")} AS src,
  {S.noise_hits('content')} AS body FROM (SELECT page_id, url, {S.PAGE_TITLE} AS title, coalesce({S.clean_html('html')}, '') AS content FROM pages)),
v AS (SELECT *, len(old) > 0 AS o, CASE WHEN len(src) > 0 THEN 'source' WHEN len(body) >= {C.NOISE_DENSITY} THEN 'density' END AS r FROM h),
total AS (SELECT count(*) AS n FROM v)
SELECT 'class' AS section, CASE WHEN o AND r IS NOT NULL THEN 'both_drop' WHEN o THEN 'recovered' WHEN r IS NOT NULL THEN 'new_only' ELSE 'both_keep' END AS label,
  count(*) AS n, round(100.0 * count(*) / any_value(total.n), 4) AS pct FROM v, total GROUP BY 2
UNION ALL SELECT 'old', k, count(*), NULL FROM (SELECT unnest(old) AS k FROM v) GROUP BY k
UNION ALL SELECT r, k, count(*), NULL FROM (SELECT r, unnest(CASE WHEN r = 'source' THEN src ELSE body END) AS k FROM v WHERE r IS NOT NULL) GROUP BY r, k""")
def noise_rule_comparison(spark, d):
    """Both rules in one scan: each page yields its class and its keyword hits."""
    from .candidates import site_text

    site = site_text(spark, d)
    content = F.coalesce("content", F.lit(""))
    hits = site.select(
        text.noise_hits(F.concat_ws(" ", "title", content)).alias("old"),
        text.noise_hits(F.concat_ws(" ", "title", "url")).alias("src"), text.noise_hits(content).alias("body"))
    rule = F.when(F.size("src") > 0, "source").when(F.size("body") >= C.NOISE_DENSITY, "density")
    old = F.size("old") > 0
    kind = F.when(old & rule.isNotNull(), "both_drop").when(old, "recovered").when(rule.isNotNull(), "new_only").otherwise("both_keep")

    def tagged(section, values):
        return F.transform(values, lambda k: F.struct(section.alias("section"), k.alias("label")))

    none = F.array().cast("array<string>")
    new_hits = F.when(rule == "source", F.col("src")).when(rule == "density", F.col("body")).otherwise(none)
    facts = F.concat(tagged(F.lit("class"), F.array(kind)), tagged(F.lit("old"), F.col("old")), tagged(rule, new_hits))
    counts = hits.select(F.explode(facts).alias("f")).groupBy("f.section", "f.label").agg(F.count("*").alias("n"))
    total = counts.where("section = 'class'").agg(F.sum("n")).scalar()
    return counts.select("section", "label", "n", F.when(F.col("section") == "class", rounded(100.0 * F.col("n") / total, 4)).alias("pct"))


@query("web_evidence_refine", S.WEB + " SELECT query_id, pos, chunk_uuid, source_url, score FROM refined")
def web_evidence_refine(spark, d):
    return refined_web(spark, d).select("query_id", "pos", "chunk_uuid", "source_url", "score")


@query("needs_rewrite_flag", f"""
SELECT conv_id, turn, len(list_intersect({S.tokens('text')}, [{S.strs(C.ANAPHORA)}])) > 0 OR len({S.tokens('text')}) < {C.MIN_TOKENS} AS needs_rewrite
FROM conversations""")
def needs_rewrite_flag(spark, d):
    toks = text.word_tokens(F.col("text"))
    words = F.array(*[F.lit(w) for w in C.ANAPHORA])
    return spread(table(spark, d, "conversations"), "conv_id").select(
        "conv_id", "turn", (F.arrays_overlap(toks, words) | (F.size(toks) < C.MIN_TOKENS)).alias("needs_rewrite"))


def sql_signals(x: str) -> str:
    line = f"lower({S.squeeze(x)})"
    tests = ", ".join(f"CASE WHEN {S.has_word(line, '|'.join(p))} THEN '{n}' END" for n, p in sorted(C.INTENT_PATTERNS.items()))
    return f"list_filter([{tests}], lambda s: s IS NOT NULL)"


@query("intent_signals", f"""
SELECT array_to_string({sql_signals('text')}, ',') AS signals, count(*) AS n FROM conversations GROUP BY 1""")
def intent_signals(spark, d):
    log = spread(table(spark, d, "conversations"), "conv_id")
    return log.select(F.array_join(gate.intent_signals(F.col("text")), ",").alias("signals")).groupBy("signals").agg(F.count("*").alias("n"))


ROUTED_SQL = f"""
s AS (SELECT *, {sql_signals('text')} AS signals FROM conversations),
routed AS (SELECT *, CASE WHEN list_contains(signals, 'comparison') THEN 'comparison' WHEN list_contains(signals, 'listicle') THEN 'listicle'
  WHEN list_contains(signals, 'factual') THEN 'factual' ELSE 'open' END AS task FROM s)"""


@query("task_and_strategy", "WITH " + ROUTED_SQL + """
SELECT task, CASE WHEN task = 'listicle' THEN 10 WHEN task = 'factual' AND len(signals) > 1 THEN 7 ELSE 5 END AS "limit",
  task = 'listicle' OR (task = 'factual' AND len(signals) > 1) AS "window", task = 'comparison' AS decompose,
  task = 'open' OR list_contains(signals, 'temporal') AS web, count(*) AS n FROM routed GROUP BY 1, 2, 3, 4, 5""")
def task_and_strategy(spark, d):
    log = spread(table(spark, d, "conversations"), "conv_id")
    routed = log.select(gate.intent_signals(F.col("text")).alias("signals"))
    task = gate.primary_task(F.col("signals"))
    out = routed.select(task.alias("task"), gate.strategy(task, F.col("signals")).alias("s"))
    return out.select("task", "s.*").groupBy("task", "limit", "window", "decompose", "web").agg(F.count("*").alias("n"))


CUT = f"(?is)^(.*{S.NW}|)(vs|versus|and|compare)({S.NW}.*|)$"


@query("query_decompose", f"""
WITH c AS (SELECT conv_id, turn, text, {S.strip(f"regexp_extract(text, '{CUT}', 1)")} AS l, {S.strip(f"regexp_extract(text, '{CUT}', 3)")} AS r FROM conversations)
SELECT conv_id, turn, 0 AS part_no, CASE WHEN l <> '' AND r <> '' THEN l ELSE text END AS sub_query FROM c
UNION ALL SELECT conv_id, turn, 1, r FROM c WHERE l <> '' AND r <> ''""")
def query_decompose(spark, d):
    log = spread(table(spark, d, "conversations"), "conv_id")
    return log.select("conv_id", "turn", F.posexplode(gate.decompose(F.col("text"))).alias("part_no", "sub_query"))


# ---------------------------------------------------------------- grounding over part-derived queries

QUESTION = "'Is ' || {n} || ' of ' || {t} || ' ' || p_size || ' better than ' || p_brand || '?'"


def initcap(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def sql_spans(x: str, initial: bool) -> str:
    stop, roman, conn = S.strs(C.SPAN_STOPWORDS), S.strs(C.ROMAN_NUMERALS), S.strs(C.CONNECTORS)
    toks = S.name_tokens(x)
    cap = "(regexp_matches({t}, '^[A-Z]') AND lower({t}) NOT IN (" + stop + "))"
    skip = "" if initial else "WHEN i = 1 THEN '|' "
    mark = f"""CASE {skip}WHEN {cap.format(t='t')} THEN '^' || lower(t)
      WHEN regexp_full_match(t, '[0-9]+') OR (upper(t) = t AND lower(t) IN ({roman}))
        OR (lower(t) IN ({conn}) AND {cap.format(t="coalesce(T[i+1], '')")}) THEN '~' || lower(t) ELSE '|' END"""
    mark = mark.replace("T[i+1]", f"({toks})[i+1]")
    line = f"array_to_string(list_transform({toks}, lambda t, i: {mark}), ' ')"
    return f"list_transform(regexp_extract_all({line}, '\\^[^ ]+(?: [\\^~][^ ]+)*'), lambda r: regexp_replace(r, '[\\^~]', '', 'g'))"


PART_Q = f"""
pq AS MATERIALIZED (SELECT p_partkey AS query_id, {QUESTION.format(n=initcap('p_name'), t=initcap('p_type'))} AS message,
  'Tell me about ' || {initcap('p_name')} || ' ' || p_size || ' now' AS ask, {initcap('p_name')} || ' ' || p_size AS title, p_type FROM part)"""


def part_queries(spark, d):
    part = table(spark, d, "part")
    name, kind = F.initcap("p_name"), F.initcap("p_type")
    size = F.col("p_size").cast("string")
    message = F.concat(F.lit("Is "), name, F.lit(" of "), kind, F.lit(" "), size, F.lit(" better than "), "p_brand", F.lit("?"))
    return part.select(
        F.col("p_partkey").alias("query_id"), message.alias("message"),
        F.concat(F.lit("Tell me about "), name, F.lit(" "), size, F.lit(" now")).alias("ask"),
        F.concat(name, F.lit(" "), size).alias("title"), "p_type")


@query("entity_spans", "WITH " + PART_Q + f"""
SELECT query_id, greedy, CAST(generate_subscripts(spans, 1) - 1 AS INTEGER) AS span_no, unnest(spans) AS span FROM (
  SELECT query_id, FALSE AS greedy, {sql_spans('message', False)} AS spans FROM pq
  UNION ALL SELECT query_id, TRUE, {sql_spans('message', True)} FROM pq)""")
def entity_spans(spark, d):
    asked = part_queries(spark, d)
    parts = [gate.span_rows(asked, "message", g).withColumn("greedy", F.lit(g)) for g in (False, True)]
    return parts[0].unionByName(parts[1]).select("query_id", "greedy", "span_no", "span")


# titles of three of the six part types are known; the others are absent
KNOWN = ["PROMO", "SMALL", "LARGE"]
GROUND_SQL = PART_Q + f""",
known AS (SELECT DISTINCT lower(array_to_string({S.name_tokens('title')}, ' ')) AS span FROM pq WHERE p_type IN ({S.strs(KNOWN)})),
asked AS MATERIALIZED (SELECT query_id, {sql_spans('ask', False)} AS verdict, list_distinct(list_concat({sql_spans('ask', False)}, {sql_spans('ask', True)})) AS spans FROM pq),
span_rows AS MATERIALIZED (SELECT query_id, unnest(spans) AS span FROM asked),
evidence AS (SELECT DISTINCT l_partkey AS query_id, CASE l_linestatus WHEN 'O' THEN 'web' ELSE 'local' END AS source_type,
  CASE l_returnflag WHEN 'A' THEN 'The ' || title || ' Review' WHEN 'N' THEN 'Review of ' || title ELSE title || ' Guide' END AS title
  FROM lineitem JOIN pq ON pq.query_id = l_partkey),
ev AS (SELECT DISTINCT query_id, title, lower(array_to_string({S.name_tokens('title')}, ' ')) AS phrase FROM evidence WHERE source_type <> 'web'),
ev2 AS (SELECT query_id, title, regexp_replace(phrase, '^(?:(?:{"|".join(C.SPAN_STOPWORDS)})(?: |$))+', '') AS phrase FROM ev),
exact_hits AS (SELECT query_id, span FROM span_rows WHERE span IN (SELECT span FROM known)),
prefix_hits AS (SELECT s.query_id, s.span, e.title FROM span_rows s JOIN ev2 e USING (query_id) WHERE starts_with(e.phrase || ' ', s.span || ' '))"""


def part_evidence(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("query_id"), "l_returnflag",
        F.when(F.col("l_linestatus") == "O", "web").otherwise("local").alias("source_type")).distinct()
    titled = rows.join(part_queries(spark, d).select("query_id", "title"), "query_id")
    wording = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("The "), "title", F.lit(" Review")))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("Review of "), "title")).otherwise(F.concat("title", F.lit(" Guide"))))
    return titled.select("query_id", "source_type", wording.alias("source_title"))


def known_titles(spark, d):
    return part_queries(spark, d).where(F.col("p_type").isin(KNOWN))


@query("exact_title_grounding", "WITH " + GROUND_SQL + " SELECT query_id, span FROM exact_hits")
def exact_title_grounding(spark, d):
    return gate.exact_hits(gate.match_spans(part_queries(spark, d), "ask"), known_titles(spark, d), "title")


@query("prefix_title_grounding", "WITH " + GROUND_SQL + " SELECT query_id, span, title FROM prefix_hits")
def prefix_title_grounding(spark, d):
    return gate.prefix_hits(gate.match_spans(part_queries(spark, d), "ask"), part_evidence(spark, d))


@query("grounding_verdict", "WITH " + GROUND_SQL + """
SELECT query_id, CASE WHEN len(verdict) > 0 AND EXISTS (SELECT 1 FROM known) THEN query_id IN (SELECT query_id FROM exact_hits UNION SELECT query_id FROM prefix_hits) END AS grounded FROM asked""")
def grounding_verdict(spark, d):
    return gate.grounding(part_queries(spark, d), "ask", known_titles(spark, d), "title", part_evidence(spark, d))


# ---------------------------------------------------------------- verdicts over candidate lists

def annotated_sql(rows: str, name: str) -> str:
    return f"""
{name} AS MATERIALIZED (SELECT *, {S.is_noise('source_title', 'source_url', 'content')} AS is_noise,
  {S.temporal("concat_ws(' ', source_title, content)")} AS temporal FROM {rows})"""


def aggregate_sql(rows: str, name: str) -> str:
    return f"""
{name} AS (SELECT query_id, count(*) AS n_rows, max(rerank_score) FILTER (NOT is_noise) AS max_rel,
  max(rerank_score) FILTER (NOT is_noise AND source_type <> 'web') AS corpus_max,
  max(rerank_score) FILTER (NOT is_noise AND source_type = 'web') AS web_max,
  round(avg(coalesce(score, 0)) FILTER (NOT is_noise), 6) AS avg_score,
  coalesce(bool_or(temporal) FILTER (NOT is_noise), FALSE) AS temporal,
  count(*) FILTER (NOT is_noise) AS evidence_count FROM {rows} GROUP BY query_id)"""


@query("relevance_aggregate", S.BOTH + ", both_rows AS (SELECT * FROM local UNION ALL BY NAME SELECT * FROM refined),"
       + annotated_sql("both_rows", "noted") + "," + aggregate_sql("noted", "agg") + """
SELECT query_id, max_rel, corpus_max, web_max, avg_score, temporal, evidence_count FROM agg""")
def relevance_aggregate(spark, d):
    rows = local_candidates(spark, d).unionByName(refined_web(spark, d))
    return gate.relevance_aggregate(gate.annotate(rows)).drop("n_rows")


@query("entity_coverage_balance", S.LOCAL + """
, per AS (SELECT query_id, coalesce(nullif(retrieval_context, ''), nullif(source_title, '')) AS entity, count(*) AS c FROM local GROUP BY ALL)
SELECT query_id, count(*) AS entities, max(c) AS max_n, min(c) AS min_n, count(*) < 2 OR max(c) > 3 * min(c) AS unbalanced
FROM per WHERE entity IS NOT NULL GROUP BY query_id""")
def entity_coverage_balance(spark, d):
    return gate.entity_balance(local_candidates(spark, d))


def opening_titles(spark, d):
    """Known names: the opening word of every document judged good."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id")
    return docs.select(text.first_name_token(F.col("text")).alias("title")).where("title IS NOT NULL").distinct()


def graded(spark, d, rows, providers, queries=None):
    queries = queries_of(spark, d) if queries is None else queries
    noted = gate.annotate(rows)
    grounded = gate.grounding(queries, "text", opening_titles(spark, d), "title", noted.where("NOT is_noise"))
    return gate.verdicts(queries, gate.relevance_aggregate(noted), grounded, providers)


def grounded_sql(rows: str, name: str) -> str:
    return f"""
{name}_ev AS (SELECT DISTINCT query_id, regexp_replace(lower(array_to_string({S.name_tokens('source_title')}, ' ')), '^(?:(?:{"|".join(C.SPAN_STOPWORDS)})(?: |$))+', '') AS phrase
  FROM {rows} WHERE NOT is_noise AND source_type <> 'web'),
{name}_hit AS (SELECT query_id FROM qspan WHERE span IN (SELECT span FROM opening)
  UNION SELECT s.query_id FROM qspan s JOIN {name}_ev e USING (query_id) WHERE starts_with(e.phrase || ' ', s.span || ' ')),
{name} AS (SELECT query_id, CASE WHEN len({sql_spans('qtext', False)}) > 0 THEN query_id IN (SELECT query_id FROM {name}_hit) END AS grounded FROM qry)"""


OPENING = f"""
opening AS MATERIALIZED (SELECT DISTINCT lower(({S.name_tokens('text')})[1]) AS span FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
qspan AS MATERIALIZED (SELECT query_id, unnest(list_distinct(list_concat({sql_spans('qtext', False)}, {sql_spans('qtext', True)}))) AS span FROM qry),
floors AS (SELECT * FROM (VALUES ('local', -3.0::DOUBLE, 2.0::DOUBLE), ('hfspace', -3.0, 2.0), ('cloudflare', 0.02, 0.90), ('voyage', NULL, NULL)) AS f(provider, refuse, weak))"""


def verdict_sql(rows: str, name: str) -> str:
    """CTEs ending in {name}: the verdict rows of a candidate table."""
    code = "CASE WHEN {v} < refuse THEN 0 WHEN {v} < weak THEN 1 ELSE 2 END"
    return annotated_sql(rows, f"{name}_n") + "," + aggregate_sql(f"{name}_n", f"{name}_a") + "," + grounded_sql(f"{name}_n", f"{name}_g") + f""",
{name}_j AS (SELECT *, {code.format(v='max_rel')} AS obs, CASE WHEN corpus_max IS NULL THEN 0 ELSE {code.format(v='corpus_max')} END AS ceil,
    n_rows IS NULL AS none, coalesce(evidence_count, 1) = 0 AS noise, coalesce(NOT grounded, FALSE) AS absent, max_rel IS NULL OR refuse IS NULL AS skipped
  FROM (SELECT query_id FROM qry) CROSS JOIN floors LEFT JOIN {name}_a USING (query_id) LEFT JOIN {name}_g USING (query_id)),
{name} AS MATERIALIZED (SELECT query_id, provider,
  ['quality_empty', 'quality_weak', 'quality_ok'][1 + CASE WHEN none THEN 0 WHEN noise THEN 1 WHEN absent THEN 0 WHEN skipped THEN 2 ELSE least(obs, ceil) END] AS status,
  CASE WHEN none THEN 'no_evidence' WHEN noise THEN 'only_noise' WHEN absent THEN 'entity_absent' WHEN skipped THEN 'floor_skipped'
    WHEN ceil < obs THEN 'web_clamped' ELSE ['below_refuse_floor', 'below_weak_floor', 'sufficient'][1 + obs] END AS reason,
  CASE WHEN none OR noise OR absent THEN 0.0 WHEN skipped THEN avg_score ELSE max_rel END AS confidence,
  coalesce(temporal, FALSE) AS temporal, grounded, coalesce(evidence_count, 0) AS evidence_count,
  CASE WHEN NOT (none OR noise OR absent OR skipped) THEN ['quality_empty', 'quality_weak', 'quality_ok'][1 + obs] END AS observed,
  CASE WHEN NOT (none OR noise OR absent OR skipped) THEN ['quality_empty', 'quality_weak', 'quality_ok'][1 + ceil] END AS ceiling,
  NOT (none OR noise OR absent OR skipped) AND ceil < obs AS clamped FROM {name}_j)"""


LOCAL_VERDICT = S.LOCAL + "," + OPENING + "," + verdict_sql("local", "v")
BOTH_VERDICT = S.BOTH + ", both_rows AS (SELECT * FROM local UNION ALL BY NAME SELECT * FROM refined)," + OPENING + "," + verdict_sql("local", "v") + "," + verdict_sql("both_rows", "m")


@query("quality_verdict", LOCAL_VERDICT + " SELECT query_id, provider, status, reason, confidence, temporal, grounded, evidence_count FROM v")
def quality_verdict(spark, d):
    out = graded(spark, d, local_candidates(spark, d), list(C.FLOORS))
    return out.drop("observed", "ceiling", "clamped")


@query("quality_status_distribution", LOCAL_VERDICT + """
SELECT provider, status, count(*) AS n, round(100.0 * count(*) / any_value(t.c), 2) AS pct, round(avg(confidence), 4) AS avg_confidence,
  round(100.0 * count(*) FILTER (status <> 'quality_ok') / any_value(t.c), 2) AS fallback_rate
FROM v JOIN (SELECT provider, count(*) AS c FROM v GROUP BY 1) t USING (provider) GROUP BY 1, 2""")
def quality_status_distribution(spark, d):
    """Share of each status; weak and empty verdicts trigger the web fallback."""
    rows = graded(spark, d, local_candidates(spark, d), list(C.FLOORS))
    per = rows.groupBy("provider", "status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    # at most one row per provider and status from here on
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy("provider"))
    falls = F.when(F.col("status") != "quality_ok", F.col("n")).otherwise(0)
    return per.select("provider", "status", "n", rounded(100.0 * F.col("n") / total, 2).alias("pct"), "avg_confidence",
                      rounded(100.0 * falls / total, 2).alias("fallback_rate"))


@query("web_ceiling_clamp", BOTH_VERDICT + " SELECT query_id, provider, observed, ceiling, status AS final, clamped FROM m")
def web_ceiling_clamp(spark, d):
    rows = local_candidates(spark, d).unionByName(refined_web(spark, d))
    out = graded(spark, d, rows, list(C.FLOORS))
    return out.select("query_id", "provider", "observed", "ceiling", F.col("status").alias("final"), "clamped")


@query("web_merge_regate", BOTH_VERDICT + f""",
sig AS (SELECT query_id, {sql_signals('qtext')} AS signals FROM qry),
st AS (SELECT query_id, list_contains(signals, 'temporal') OR NOT (list_contains(signals, 'comparison') OR list_contains(signals, 'listicle') OR list_contains(signals, 'factual')) AS web FROM sig),
j AS (SELECT v.query_id, v.status AS b, m.status AS a, v.status <> 'quality_ok' OR (st.web AND v.temporal) AS asks,
  v.query_id IN (SELECT query_id FROM refined) AS has FROM v JOIN m USING (query_id, provider) JOIN st USING (query_id) WHERE v.provider = 'local')
SELECT query_id, CASE WHEN asks AND has THEN 'LOCAL_PLUS_WEB' WHEN asks THEN 'LOCAL_WEB_ATTEMPTED' ELSE 'LOCAL_ONLY' END AS merge_state,
  b AS status_before, CASE WHEN asks AND has THEN a ELSE b END AS status_after FROM j""")
def web_merge_regate(spark, d):
    local, web = local_candidates(spark, d), refined_web(spark, d)
    before = graded(spark, d, local, ["local"])
    after = graded(spark, d, local.unionByName(web), ["local"])
    signals = gate.intent_signals(F.col("text"))
    settings = queries_of(spark, d).select("query_id", gate.strategy(gate.primary_task(signals), signals)["web"].alias("web"))
    return gate.web_merge(before, settings, web, after)


ASKED = {"plain": [], "comparison": ["comparison"], "temporal": ["temporal"], "both": ["comparison", "temporal"]}


@query("capability_verdict", LOCAL_VERDICT + """,
per AS (SELECT query_id, coalesce(nullif(retrieval_context, ''), nullif(source_title, '')) AS entity, count(*) AS c FROM local GROUP BY ALL),
bal AS (SELECT query_id, count(*) AS entities, count(*) < 2 OR max(c) > 3 * min(c) AS unbalanced FROM per WHERE entity IS NOT NULL GROUP BY query_id),
kinds AS (SELECT * FROM (VALUES ('plain', FALSE, FALSE), ('comparison', TRUE, FALSE), ('temporal', FALSE, TRUE), ('both', TRUE, TRUE)) AS k(asked, cmp, dated)),
j AS (SELECT v.query_id, asked, status, reason, evidence_count, cmp, cmp AND coalesce(entities, 0) < 2 AS narrow, cmp AND coalesce(unbalanced, TRUE) AS lop, dated AND NOT temporal AS stale
  FROM v CROSS JOIN kinds LEFT JOIN bal USING (query_id) WHERE provider = 'local')
SELECT query_id, asked, CASE WHEN status = 'quality_empty' OR narrow THEN 'insufficient' WHEN status = 'quality_weak' OR lop OR stale THEN 'partial' ELSE 'full' END AS capability,
  CASE WHEN evidence_count = 0 THEN 'no_evidence' WHEN status = 'quality_empty' THEN 'quality_empty:' || reason WHEN narrow THEN 'comparison_entity_coverage' WHEN stale THEN 'no_temporal_evidence'
    WHEN lop THEN 'unbalanced_entities' WHEN status = 'quality_weak' THEN 'weak_evidence' ELSE 'sufficient' END AS reason FROM j""")
def capability_verdict(spark, d):
    """Every query asked plainly, as a comparison and as a question about now."""
    local = local_candidates(spark, d)
    kinds = F.array(*[F.struct(F.lit(k).alias("asked"), F.array(*[F.lit(s) for s in v]).cast("array<string>").alias("signals"))
                      for k, v in ASKED.items()])
    asked = queries_of(spark, d).select("query_id", F.explode(kinds).alias("k")).select("query_id", "k.*")
    return gate.capability(asked, graded(spark, d, local, ["local"]), gate.entity_balance(local))
