"""DuckDB fragments shared by the oracle queries, written independently of the Spark side."""

from __future__ import annotations

from .. import constants as C

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NW = r"[^\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strs(values) -> str:
    return ", ".join(lit(v) for v in values)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def decode(x: str) -> str:
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, '{entity}', {lit(char)})"
    return x


def untag(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def clean_html(x: str) -> str:
    return f"nullif({squeeze(untag(decode(x)))}, '')"


def body(x: str) -> str:
    one = f"regexp_replace({untag(decode(x))}, '[ \\t]+', ' ', 'g')"
    return strip(f"regexp_replace({one}, '\\n{{2,}}', chr(10), 'g')")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{NW}+'), lambda w: w <> '')"


def compare_tokens(x: str) -> str:
    return (f"list_filter(string_split_regex(lower({x}), '{NW}+'), "
            f"lambda w: w <> '' AND w NOT IN ({strs(C.COMPARE_STOPWORDS)}))")


def whole(pattern: str) -> str:
    return f"(^|{NW})({pattern})({NW}|$)"


def has_word(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(whole(pattern))})"


def noise_hits(x: str) -> str:
    tests = ", ".join(f"CASE WHEN {has_word(f'lower({x})', w)} THEN '{w}' END" for w in sorted(C.NOISE_WORDS))
    return f"list_filter([{tests}], lambda w: w IS NOT NULL)"


def temporal(x: str) -> str:
    return has_word(f"lower({x})", "|".join(C.TEMPORAL_PATTERNS))


def is_noise(title: str, url: str, content: str) -> str:
    source = f"concat_ws(' ', {title}, {url})"
    return f"(len({noise_hits(source)}) > 0 OR len({noise_hits(content)}) >= {C.NOISE_DENSITY})"


def uuid5(name: str, space: str) -> str:
    h = f"sha1(unhex('{space.replace('-', '')}') || encode({name}))"
    return (f"substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
            f"CASE WHEN substr({h},17,1) IN ('0','4','8','c') THEN '8' WHEN substr({h},17,1) IN ('1','5','9','d') THEN '9' "
            f"WHEN substr({h},17,1) IN ('2','6','a','e') THEN 'a' ELSE 'b' END || substr({h},18,3) || '-' || substr({h},21,12)")


def slug(x: str) -> str:
    bare = f"lower(trim(regexp_replace({x}, '\\s*\\([0-9]{{4}}\\)\\s*$', '')))"
    return f"regexp_replace(regexp_replace({bare}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def name_tokens(x: str) -> str:
    for c in C.CURLY_APOSTROPHES:
        x = f"replace({x}, '{c}', '''')"
    return f"regexp_extract_all({x}, '[A-Za-z0-9'']+')"


def drop_reason(x: str) -> str:
    symbols = " + ".join(f"(length({x}) - length(replace({x}, '{s}', '')))" for s in C.PRICE_SYMBOLS)
    held = (f"list_filter(string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), "
            f"lambda l: {strip('l')} <> '')")
    chars = f"list_sum(list_transform({held}, lambda l: length(l)))"
    return f"""CASE WHEN regexp_matches({x}, '<[a-zA-Z/][^>]*>') THEN 'html'
      WHEN len({words(x)}) > {C.MAX_CHUNK_WORDS} THEN 'oversized'
      WHEN ({symbols}) / greatest(length({x}), 1) > {C.PRICE_DENSITY} THEN 'price_density'
      WHEN len({held}) = 0 OR {chars} / len({held}) < {C.MIN_LINE_CHARS} THEN 'list_like' END"""


STRIDE = C.CHUNK_WORDS - C.CHUNK_OVERLAP

# every window of every document, before the filter
WINDOWS = f"""
doc_words AS MATERIALIZED (SELECT doc_id, source, lang, {words(body('text'))} AS w FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, source, lang, CAST(s // {STRIDE} AS INTEGER) AS chunk_index,
    source || chr(10) || chr(10) ||
      CASE WHEN len(w[s+1 : s+{C.CHUNK_WORDS}]) = 1 THEN substr(w[s+1], 1, {C.GIANT_WORD})
           ELSE array_to_string(w[s+1 : s+{C.CHUNK_WORDS}], ' ') END AS content
  FROM (SELECT doc_id, source, lang, w, unnest(range(0, len(w), {STRIDE})) AS s FROM doc_words WHERE len(w) > 0))"""

CHUNKS = WINDOWS + f""",
kept AS (SELECT *, sha1(content) AS h FROM windows WHERE ({drop_reason('content')}) IS NULL),
inner_ids AS (SELECT *, {uuid5('h', C.ENTITY_NAMESPACE)} AS inner_id FROM kept),
keyed AS (SELECT {uuid5('inner_id', C.CHUNK_NAMESPACE)} AS chunk_uuid, * FROM inner_ids),
chunks AS MATERIALIZED (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_uuid ORDER BY doc_id, chunk_index) AS rn FROM keyed)
  WHERE rn = 1)"""

QUERIES = "qry AS (SELECT item_id AS query_id, text AS qtext FROM benchmark)"


def bm25(p: str, corpus: str, key: str, text: str, k: int) -> str:
    """CTEs ending in {p}_top(query_id, rank, key, score)."""
    return f"""
{p}_terms AS (SELECT DISTINCT query_id, unnest({tokens('qtext')}) AS term FROM qry),
{p}_tok AS MATERIALIZED (SELECT {key}, {tokens(text)} AS toks FROM {corpus}),
{p}_st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM {p}_tok),
{p}_post AS MATERIALIZED (SELECT {key}, doc_len, term, count(*) AS tf
  FROM (SELECT {key}, len(toks) AS doc_len, unnest(toks) AS term FROM {p}_tok) GROUP BY ALL),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_post GROUP BY term),
{p}_score AS (SELECT t.query_id, p.{key}, round(sum(ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5))
    * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.doc_len / s.avg_len))), 4) AS score
  FROM {p}_terms t JOIN {p}_df d USING (term) JOIN {p}_post p USING (term) CROSS JOIN {p}_st s
  GROUP BY t.query_id, p.{key}),
{p}_top AS MATERIALIZED (SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS INTEGER) AS rank,
    {key}, score FROM {p}_score) WHERE rank <= {k})"""


def coverage(q: str, t: str) -> str:
    ts = tokens(t)
    qs = f"list_distinct({tokens(q)})"
    return f"""CASE WHEN len({qs}) > 0 AND len({ts}) > 0
      THEN round(12.0 * len(list_intersect({qs}, {ts})) / len({qs}) - 6.0, 4) END"""


# corpus candidates of every benchmark passage: best 20 chunks
LOCAL = "WITH " + CHUNKS + ", " + QUERIES + "," + bm25("c", "chunks", "chunk_uuid", "content", C.BRANCH_DEPTH) + f""",
local AS MATERIALIZED (
  SELECT t.query_id, t.rank AS pos, t.chunk_uuid, c.content, c.source AS source_title,
    'local' AS source_type, CAST(NULL AS VARCHAR) AS source_url, c.chunk_index,
    c.source AS retrieval_context, t.score,
    {coverage('q.qtext', 'c.content')} AS rerank_score
  FROM c_top t JOIN chunks c USING (chunk_uuid) JOIN qry q USING (query_id))"""

PAGE_TITLE = squeeze(decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))

# web results of every benchmark passage: best 5 pages, in result order
WEB_PARTS = f""",
site AS MATERIALIZED (SELECT page_id, url, {PAGE_TITLE} AS title, {clean_html('html')} AS content FROM pages),""" + bm25(
    "w", "site", "page_id", "content", 5) + f""",
web AS MATERIALIZED (
  SELECT t.query_id, t.rank AS pos, CAST(s.page_id AS VARCHAR) AS chunk_uuid, s.content, s.title AS source_title,
    'web' AS source_type, s.url AS source_url, CAST(NULL AS INTEGER) AS chunk_index,
    'fallback' AS retrieval_context, round(t.score / (t.score + 10.0), 4) AS score,
    {coverage('q.qtext', 's.content')} AS rerank_score
  FROM w_top t JOIN site s USING (page_id) JOIN qry q USING (query_id)),
refined AS MATERIALIZED (
  SELECT * EXCLUDE (pos, rn), rn AS pos FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rn FROM web
    WHERE score >= {C.WEB_MIN_SCORE} AND NOT {is_noise('source_title', 'source_url', 'content')}
      AND NOT (regexp_matches(lower(source_url), '{"|".join(d.replace(".", "[.]") for d in C.WEB_UGC_DOMAINS)}')
               AND score <= {C.WEB_UGC_SCORE}))
  WHERE rn <= {C.WEB_KEEP})"""

WEB = "WITH " + QUERIES + WEB_PARTS
BOTH = LOCAL + WEB_PARTS
