"""DuckDB equivalents of the operators that SQL can express."""

from __future__ import annotations

GAP = r"[\x20\x09-\x0D]"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_RULES = rf"""
WITH base AS (
  SELECT doc_id, coalesce('=' || lang, '') AS lk, coalesce('=' || source, '') AS sk,
         {WORDS} AS w, coalesce(text, '') AS text
  FROM documents
), spread AS (
  SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM base
), three AS (
  SELECT doc_id, i, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c FROM spread WINDOW s AS (PARTITION BY doc_id ORDER BY i)
), found AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM three WHERE c IS NOT NULL
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM found, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT doc_id, lk, sk, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '{GAP}', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), measured AS (
  SELECT doc_id, lk, sk, unnest(['symbols', 'repeats', 'dup_lines', 'word_length']) AS signal,
         unnest([10000 * n_symbols // n_words, 10000 * n_repeat_words // n_words,
                 10000 * n_dup_lines // greatest(n_lines, 1), 100 * word_chars // n_words]) AS value
  FROM judged WHERE NOT base_failed
), bucketed AS (
  SELECT *, greatest(length(bin(value)) - 6, 0) AS shift FROM measured
), sketched AS (
  SELECT lk, sk, signal, shift * 32 + (value >> shift) AS bucket, count(*) AS n FROM bucketed GROUP BY ALL
), levels AS (
  SELECT level, if(level < 2, lk, '') AS lk, if(level < 1, sk, '') AS sk, signal, bucket, sum(n) AS n
  FROM sketched, (VALUES (0), (1), (2)) AS l(level) GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lk, sk, signal ORDER BY bucket) AS cum,
         sum(n) OVER (PARTITION BY level, lk, sk, signal) AS total FROM levels
), picked AS (
  SELECT level, lk, sk, signal, max(total) AS docs,
         min(CASE WHEN 10 * cum >= total THEN bucket END) AS b1, min(CASE WHEN 10 * cum >= 5 * total THEN bucket END) AS b5,
         min(CASE WHEN 10 * cum >= 9 * total THEN bucket END) + 1 AS b9
  FROM ranked GROUP BY ALL
), quantiles AS (
  SELECT *, (b1 - 32 * greatest(b1 // 32 - 1, 0)) << greatest(b1 // 32 - 1, 0) AS q1,
         (b5 - 32 * greatest(b5 // 32 - 1, 0)) << greatest(b5 // 32 - 1, 0) AS q5,
         ((b9 - 32 * greatest(b9 // 32 - 1, 0)) << greatest(b9 // 32 - 1, 0)) - 1 AS q9 FROM picked
), fences AS (
  SELECT level, lk, sk, max(docs) AS docs,
    max(CASE WHEN signal = 'symbols' THEN q5 + 3 * (q9 - q5) END) AS f_symbols,
    max(CASE WHEN signal = 'repeats' THEN q5 + 3 * (q9 - q5) END) AS f_repeats,
    max(CASE WHEN signal = 'dup_lines' THEN q5 + 3 * (q9 - q5) END) AS f_lines,
    max(CASE WHEN signal = 'word_length' THEN q5 + 3 * (q9 - q5) END) AS f_long,
    max(CASE WHEN signal = 'word_length' THEN q5 - 3 * (q5 - q1) END) AS f_short
  FROM quantiles GROUP BY ALL
), chosen AS (
  SELECT a.lk, a.sk, CASE WHEN a.docs >= 200 THEN a WHEN b.docs >= 200 THEN b ELSE c END AS f
  FROM fences a JOIN fences b ON b.level = 1 AND b.lk = a.lk JOIN fences c ON c.level = 2 WHERE a.level = 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND 10000 * (n_symbols - 1) <= f.f_symbols * n_words
         AND 10000 * (n_repeat_words - 6 - n_dup_lines * (2 * n_words // greatest(n_lines, 1))) <= f.f_repeats * n_words
         AND 10000 * (n_dup_lines - 1) <= f.f_lines * n_lines
         AND 100 * word_chars // n_words <= f.f_long AND 100 * word_chars // n_words >= f.f_short, false) AS kept
FROM judged LEFT JOIN chosen USING (lk, sk)
"""

MIXING = rf"""
WITH base AS (
  SELECT doc_id, coalesce('=' || source, '') AS sk, len({WORDS})::BIGINT AS size,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), sources AS (
  SELECT sk, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY sk = '', sk) - 1 AS rank FROM base GROUP BY sk
), weighed AS (
  SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, greatest(ceil(source_size / 32768.0), 1)::BIGINT AS shards FROM sources
), filled AS (
  SELECT *, coalesce(sum(3 * source_size) OVER f, 0) AS used, coalesce(sum(weight) OVER f, 0) AS weight_used,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM weighed WINDOW f AS (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levelled AS (
  SELECT *, max((total - used)::DOUBLE / (weights - weight_used)::DOUBLE) OVER () AS level FROM filled
), aimed AS (
  SELECT sk, rank, source_size, shards, total, least(3 * source_size::DOUBLE, level * weight) AS target FROM levelled
), asked AS (
  SELECT sk, target / (2 * k + 1) AS quotient, rank, (total // 32 + if(2 * (total % 32) >= 32, 1, 0)) AS seats
  FROM aimed, LATERAL (SELECT unnest(range((target / 32)::BIGINT + 50)) AS k) WHERE target > 0
), won AS (
  SELECT sk, count(*) AS seats
  FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, rank) AS pos FROM asked) WHERE pos <= seats GROUP BY sk
), placed AS (
  SELECT b.*, h % shards AS shard, source_size, target FROM base b JOIN aimed USING (sk)
), shard_sizes AS (
  SELECT sk, shard, sum(size)::BIGINT AS n FROM placed GROUP BY ALL
), shard_asked AS (
  SELECT sk, shard, n / (2 * k + 1) AS quotient, seats
  FROM shard_sizes JOIN won USING (sk), LATERAL (SELECT unnest(range(3 * n // 32 + 50)) AS k) WHERE n > 0
), shard_won AS (
  SELECT sk, shard, count(*) AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY quotient DESC, shard) AS pos FROM shard_asked)
  WHERE pos <= seats GROUP BY ALL
), quotas AS (
  SELECT sk, shard, n, least(coalesce(q, 0) * 32, 3 * n) AS words,
    (('0x' || substr(md5('11:' || sk || '/' || shard), 1, 15))::BIGINT % greatest(ceil(n / 32.0), 1)::BIGINT) * 32 AS begins
  FROM shard_sizes LEFT JOIN shard_won USING (sk, shard)
), laid AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY sk, shard ORDER BY h, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM placed JOIN quotas USING (sk, shard)
), cut AS (
  SELECT *, words // greatest(n, 1) AS copies, words - words // greatest(n, 1) * n AS rest FROM laid
)
SELECT doc_id, size, source_size, target,
  (copies * size + greatest(least(begins + rest, pos + size) - greatest(begins, pos), 0)
   + greatest(least(begins + rest - n, pos + size) - pos, 0))::BIGINT AS taken
FROM cut
"""

_KEY = """host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END"""


def _parts(url: str, source: str, more: str) -> str:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END"
    return rf"""
  SELECT {more}, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_aggregate(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)')), 'string_agg', '&') AS kept_list,
         coalesce(kept_list, '') AS kept, CASE WHEN rest IS NOT NULL THEN {_KEY} END AS key
  FROM (SELECT *, {rest} AS rest FROM {source})"""


_FITS = """(host = r.rh OR ends_with(host, '.' || r.rh)) AND starts_with(path, r.rp)"""

URL_FILTER = rf"""
WITH RECURSIVE rules(rv, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), parsed AS ({_parts("url", "pages", "page_id, html, url")}
), tags AS (
  SELECT host, path, key, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM parsed WHERE key IS NOT NULL
), hrefs AS (
  SELECT *, replace(CASE WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical')
      THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh')
      THEN regexp_extract(tag, '(?i)url\s*=\s*[''"]?([^"''\s>]+)', 1) ELSE '' END, '&amp;', '&') AS t FROM tags
), aimed AS (
  SELECT key AS from_key, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN starts_with(t, '/') THEN 'http://' || host || t
    ELSE 'http://' || host || coalesce(nullif(regexp_extract(path, '^.*/'), ''), '/') || t END AS target
  FROM hrefs WHERE t <> ''
), ends AS ({_parts("target", "aimed", "from_key")}
), edges AS (
  SELECT from_key AS a, key AS b FROM ends UNION SELECT key, from_key FROM ends
), reach AS (
  SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
), keys AS (
  SELECT key, host, path FROM parsed WHERE key IS NOT NULL UNION SELECT key, host, path FROM ends
), fitted AS (
  SELECT key, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
  FROM keys JOIN rules r ON {_FITS} GROUP BY key
), aliases AS (
  SELECT reach.a AS key, bool_or(rv = 'block') AND NOT bool_or(rv = 'allow') AS blocked
  FROM reach JOIN fitted ON fitted.key = reach.b GROUP BY reach.a
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(rv, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM parsed LEFT JOIN fitted USING (key) LEFT JOIN aliases USING (key)
"""

LINE_DEDUP = """
WITH spread AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM spread
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.*, s.first IS NOT NULL AND s.first <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SPELLING = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), counted_runs AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), coded AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM counted_runs
), hashed AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM coded, crc_table
), spelled AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (
  SELECT word, n, unnest(range(length(word)))::INT AS place FROM words
), cut AS MATERIALIZED (
  SELECT word, n, place, substr(word, 1, place) || substr(word, place + 2) AS rest FROM places
), near AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, arg_min(near, (-n, near)) AS near FROM near GROUP BY word
), judged AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * words.n THEN near END AS form,
         CASE WHEN most >= 10 * words.n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word)
), steps AS (
  SELECT word, form AS root FROM judged WHERE form IS NOT NULL
  UNION SELECT steps.word, judged.form FROM steps JOIN judged ON judged.word = steps.root WHERE judged.form IS NOT NULL
), ends AS (
  SELECT steps.word, steps.root FROM steps JOIN judged ON judged.word = steps.root WHERE judged.form IS NULL
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM judged LEFT JOIN ends USING (word)
"""
