"""Cleaning, keying and token-frequency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import keys, text
from ..schemas import EVENT_PROPS
from ..sources.tables import spread, table
from . import sql as S
from .registry import query


def host(url):
    return F.regexp_extract(url, "^https?://([^/]+)", 1)


@query("html_clean", f"""
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id, sha256({S.clean_html('html')}) AS text_hash,
  length(html) - coalesce(length({S.clean_html('html')}), 0) AS removed FROM pages""")
def html_clean(spark, d):
    clean = text.clean_html(F.col("html"))
    pages = spread(table(spark, d, "pages"), "page_id").select("page_id", host(F.col("url")).alias("host"), F.length("html").alias("n"), clean.alias("t"))
    return pages.select("host", "page_id", F.sha2("t", 256).alias("text_hash"), (F.col("n") - F.coalesce(F.length("t"), F.lit(0))).cast("bigint").alias("removed"))


@query("chunk_text_normalize", f"""
WITH b AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, {S.body('html')} AS t FROM pages)
SELECT host, count(*) AS pages, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(length(t) - length(replace(t, chr(10), '')) + 1) AS BIGINT) AS lines,
  CAST(sum(len({S.words('t')})) AS BIGINT) AS words FROM b GROUP BY host""")
def chunk_text_normalize(spark, d):
    body = spread(table(spark, d, "pages"), "page_id").select(host(F.col("url")).alias("host"), text.normalize_body(F.col("html")).alias("t"))
    return body.groupBy("host").agg(
        F.count("*").alias("pages"), F.sum(F.length("t")).alias("chars"),
        F.sum(text.occurrences(F.col("t"), "\n").cast("bigint") + 1).alias("lines"), F.sum(F.size(text.split_words(F.col("t")))).alias("words"))


@query("array_dedupe_ci", f"""
WITH t AS (SELECT doc_id, unnest({S.words('text')}) AS value, generate_subscripts({S.words('text')}, 1) - 1 AS pos FROM documents)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, arg_min(value, pos) AS value FROM t GROUP BY doc_id, lower(value)""")
def array_dedupe_ci(spark, d):
    """Words of each document, each once whatever its case; all of it inside the row."""
    docs = spread(table(spark, d, "documents"), "doc_id")
    first = text.first_of_each(text.split_words(F.col("text")))
    return docs.select("doc_id", F.explode(first).alias("f")).select("doc_id", "f.pos", "f.value")


TITLES = "SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || CASE WHEN p_size > 25 THEN ' (' || (1990 + p_size) || ')' ELSE '' END AS title, 1990 + p_size AS year FROM part"


def titles(spark, d):
    year = F.col("p_size") + 1990
    suffix = F.when(F.col("p_size") > 25, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise("")
    return table(spark, d, "part").select(F.concat(F.initcap("p_name"), suffix).alias("title"), year.alias("year"))


@query("slug_keys", f"WITH t AS ({TITLES}) SELECT {S.slug('title')} AS slug, count(DISTINCT title) AS titles, count(*) AS n FROM t GROUP BY 1 HAVING count(DISTINCT title) > 1")
def slug_keys(spark, d):
    """Slugs that several titles share; titles are merged before they are grouped."""
    per = titles(spark, d).groupBy("title").agg(F.count("*").alias("c"))
    out = per.groupBy(keys.slug(F.col("title")).alias("slug")).agg(F.count("*").alias("titles"), F.sum("c").alias("n"))
    return out.where("titles > 1")


@query("uuid5_keys", f"""
WITH t AS (SELECT {S.slug('title')} || '-' || year AS key, count(*) AS n FROM ({TITLES}) GROUP BY 1)
SELECT key, {S.uuid5('key', C.ENTITY_NAMESPACE)} AS uuid, n FROM t""")
def uuid5_keys(spark, d):
    key = keys.entity_id(F.col("title"), F.col("year"))
    per = titles(spark, d).groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    return per.select("key", keys.uuid5(F.col("key"), C.ENTITY_NAMESPACE).alias("uuid"), "n")


@query("content_hash_groups", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS min_id FROM documents GROUP BY 1")
def content_hash_groups(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("min_id"))


# one date notation per order priority, the last two not accepted
@query("date_standardize", """
WITH s AS (SELECT o_orderdate AS ts, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
    WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN '5-LOW' THEN '' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS raw,
  CASE WHEN o_orderpriority = '5-LOW' THEN epoch(o_orderdate)::BIGINT END AS unix FROM orders),
p AS (SELECT raw, unix, try_strptime(raw, '%Y-%m-%d') AS a, try_strptime(raw, '%Y-%m-%dT%H:%M:%S') AS b, try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ') AS c FROM s),
f AS (SELECT CASE WHEN a IS NOT NULL THEN 'date' WHEN b IS NOT NULL THEN 'datetime' WHEN c IS NOT NULL THEN 'datetime_z' WHEN nullif(unix, 0) IS NOT NULL THEN 'unix' WHEN raw = '' THEN 'empty' ELSE 'failed' END AS format,
  CAST(coalesce(a, b, c, to_timestamp(nullif(unix, 0)) AT TIME ZONE 'UTC') AS DATE) AS day FROM p)
SELECT format, count(*) AS n, min(day) AS first_day, max(day) AS last_day, count(DISTINCT year(day)) AS years FROM f GROUP BY format""")
def date_standardize(spark, d):
    when = F.col("o_orderdate")
    raw = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(when, "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.date_format(when, "dd/MM/yyyy")))
    unix = F.when(F.col("o_orderpriority") == "5-LOW", F.unix_timestamp(when.cast("timestamp")))
    rows = table(spark, d, "orders").select(raw.alias("raw"), unix.alias("unix"))
    formats = {"date": "yyyy-MM-dd", "datetime": "yyyy-MM-dd'T'HH:mm:ss", "datetime_z": "yyyy-MM-dd'T'HH:mm:ss'Z'"}
    parsed = rows.select("*", *[F.try_to_timestamp("raw", F.lit(f)).alias(k) for k, f in formats.items()],
                         F.timestamp_seconds(F.nullif(F.col("unix"), F.lit(0))).alias("by_unix"))
    kind = F.when(F.col("by_unix").isNotNull(), "unix").when(F.col("raw") == "", "empty").otherwise("failed")
    for k in reversed(formats):
        kind = F.when(F.col(k).isNotNull(), k).otherwise(kind)
    day = F.to_date(F.coalesce(*formats, "by_unix"))
    per = parsed.select(kind.alias("format"), day.alias("day")).groupBy("format", F.year("day").alias("y")).agg(
        F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    return per.groupBy("format").agg(F.sum("n").alias("n"), F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.count("y").alias("years"))


@query("typed_load_report", """
WITH r AS (SELECT unnest(['value', 'user_id', 'event_type', 'props']) AS "column", unnest([value::VARCHAR, user_id::VARCHAR, event_type, props]) AS raw,
  unnest([TRY_CAST(value::VARCHAR AS DOUBLE), TRY_CAST(user_id AS DOUBLE), TRY_CAST(event_type AS DOUBLE), TRY_CAST(props AS DOUBLE)]) AS typed FROM events)
SELECT "column", count(*) FILTER (raw IS NOT NULL AND typed IS NULL) AS failed, count(*) FILTER (typed IS NOT NULL) AS ok FROM r GROUP BY 1""")
def typed_load_report(spark, d):
    kinds = {"value": "double", "user_id": "bigint", "event_type": "bigint", "props": "double"}
    raw = table(spark, d, "events").select(*[F.col(c).cast("string").alias(c) for c in kinds])
    counts = raw.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull()).alias(f"{c}_failed") for c, k in kinds.items()],
                     *[F.count_if(F.col(c).try_cast(k).isNotNull()).alias(f"{c}_ok") for c, k in kinds.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_failed").alias("failed"), F.col(f"{c}_ok").alias("ok")) for c in kinds])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@query("json_flatten_agg", """
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1""")
def json_flatten_agg(spark, d):
    rows = table(spark, d, "events").select(F.from_json("props", EVENT_PROPS)["k"].alias("k"), "value")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("vector_normalize_stats", """
WITH n AS (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)
SELECT label, count(*) AS n, round(avg(norm), 6) AS avg_norm, round(min(norm), 6) AS min_norm, round(max(norm), 6) AS max_norm,
  count(*) FILTER (norm > 0) AS unit_vectors FROM n GROUP BY label""")
def vector_normalize_stats(spark, d):
    from ..operators.integrity import norm, unit

    rows = table(spark, d, "embeddings").select("label", norm("embedding").alias("norm"), norm_of_unit(unit("embedding")).alias("u"))
    return rows.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg("norm"), 6).alias("avg_norm"), F.round(F.min("norm"), 6).alias("min_norm"),
        F.round(F.max("norm"), 6).alias("max_norm"), F.count_if(F.abs(F.col("u") - 1) < 1e-6).alias("unit_vectors"))


def norm_of_unit(vec):
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))


@query("token_document_frequency", f"""
SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({S.compare_tokens('text')})) AS token FROM documents) GROUP BY token""")
def token_document_frequency(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    return docs.select(F.explode(text.compare_set(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@query("folded_token_counts", f"SELECT lower(t) AS token, count(*) AS n FROM (SELECT unnest({S.name_tokens('text')}) AS t FROM documents) GROUP BY 1")
def folded_token_counts(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    return docs.select(F.explode(text.name_tokens(F.col("text"))).alias("t")).groupBy(F.lower("t").alias("token")).agg(F.count("*").alias("n"))
