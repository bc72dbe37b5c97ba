"""Scan, write, cleaning and identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import keys, text
from ..operators import ingest
from ..session import scratch_path
from ..sources import tables
from ..sources.store import stored
from ..sources.tables import spread, table
from . import sql as S
from .registry import query


@query("scan_projected", "SELECT doc_id, lang, source FROM documents")
def scan_projected(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source")


@query("scan_filtered_count", "SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10'")
def scan_filtered_count(spark, d):
    rows = table(spark, d, "events").where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))
    return rows.agg(F.count("*").alias("n"))


def checksum(vec):
    return F.round(F.aggregate(F.transform(vec, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4)


@query("jsonl_roundtrip", """
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 4) AS checksum FROM embeddings""")
def jsonl_roundtrip(spark, d):
    """Snapshot to JSON Lines and restore; the restored rows are checked."""
    path = scratch_path(spark, "snapshot")
    stored = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    tables.write_jsonl(stored, path)
    back = tables.read_jsonl(spark, path, "vec_id BIGINT, label INT, embedding ARRAY<FLOAT>")
    return back.select("vec_id", "label", F.size("embedding").alias("dims"), checksum("embedding").alias("checksum"))


@query("upsert_insert_if_absent", """
SELECT CAST(count(*) AS BIGINT) AS rows_after, count(*) FILTER (o_orderstatus <> 'F') AS inserted, count(*) FILTER (o_orderstatus = 'F') AS skipped,
  CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders""")
def upsert_insert_if_absent(spark, d):
    """Finished orders are stored; the whole table arrives as a batch."""
    batch = table(spark, d, "orders")
    target = batch.where("o_orderstatus = 'F'")
    after, inserted = tables.insert_if_absent(target, batch, "o_orderkey")
    tagged = after.select("o_orderkey", F.lit(0).alias("new")).unionByName(inserted.select("o_orderkey", F.lit(1).alias("new")))
    total = batch.agg(F.count("*")).scalar()
    return tagged.agg(
        F.count_if(F.col("new") == 0).alias("rows_after"), F.count_if(F.col("new") == 1).alias("inserted"),
        F.sum(F.when(F.col("new") == 0, F.col("o_orderkey"))).alias("key_sum"),
    ).select("rows_after", "inserted", (total - F.col("inserted")).alias("skipped"), "key_sum")


@query("upsert_overwrite", """
WITH v AS (SELECT o_orderkey AS id, 1 AS version, o_orderstatus AS status, o_totalprice AS total FROM orders
  UNION ALL SELECT l_orderkey, 2 + l_linenumber, l_linestatus, l_extendedprice FROM lineitem)
SELECT id, arg_max(version, (version, status, total)) AS version, arg_max(status, (version, status, total)) AS status, arg_max(total, (version, status, total)) AS total FROM v GROUP BY id""")
def upsert_overwrite(spark, d):
    """Order rows overwritten by their line rows; the highest version wins."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    later = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") + 2).alias("version"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("total"))
    return tables.overwrite_by_key(base.unionByName(later), "id", ["version", "status", "total"])


@query("resume_pending", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE NOT (quality = 0 AND toxic = 0))""")
def resume_pending(spark, d):
    """Documents without a usable judgement; a zero in a score column counts as not judged."""
    done = table(spark, d, "labels").select("doc_id", F.nullif("quality", F.lit(0)).alias("quality"), F.nullif("toxic", F.lit(0)).alias("toxic"))
    return tables.pending(table(spark, d, "documents").select("doc_id"), done, "doc_id", ["quality", "toxic"])


SOURCES = [f"src{i}" for i in range(15)]


@query("contract_quarantine", f"""
SELECT doc_id, r IS NULL AS accepted, r AS reject_reason FROM (SELECT doc_id, CASE WHEN text IS NULL OR {S.strip('text')} = '' THEN 'empty_content'
  WHEN doc_id IS NULL THEN 'missing_owner' WHEN source NOT IN ({S.strs(SOURCES)}) THEN 'bad_source' WHEN lang NOT IN ('en', 'fr') THEN 'bad_content_type' END AS r FROM documents)""")
def contract_quarantine(spark, d):
    reason = (
        F.when(text.blank(F.col("text")), "empty_content").when(F.col("doc_id").isNull(), "missing_owner")
        .when(~F.coalesce("source", F.lit("")).isin(SOURCES), "bad_source").when(~F.coalesce("lang", F.lit("")).isin("en", "fr"), "bad_content_type"))
    def build():
        docs = spread(table(spark, d, "documents"), "doc_id")
        return docs.select("*", reason.alias("reject_reason"), reason.isNull().alias("accepted"))

    # accepted rows and the quarantine are the two folders of one write
    return stored(spark, d, "contract", ["documents"], build, split_by="accepted").select("doc_id", "accepted", "reject_reason")


# ---------------------------------------------------------------- nested records

@query("prune_fields_recursive", """
SELECT page_id, url, 'url,page.title,page.items.alt' AS fields, length(html) AS title, split_part(url, '/', 3) || ',' || split_part(url, '/', 4) AS alts FROM pages""")
def prune_fields_recursive(spark, d):
    pages = table(spark, d, "pages")
    parts = F.split("url", "/")
    items = F.transform(F.slice(parts, 3, 2), lambda p: F.struct(p.alias("alt"), F.col("url").alias("thumbnail_url")))
    nested = pages.select(
        "page_id", "url", F.struct(F.length("html").cast("bigint").alias("title"), F.col("html").alias("Background"), items.alias("items")).alias("page"),
        F.struct(F.col("url").alias("href")).alias("coverImage"), F.col("url").alias("avatar_url"), F.array("url").alias("Artworks"))
    out = ingest.prune_fields(nested)

    def paths(kind, prefix=""):
        for f in kind.fields:
            inner = getattr(f.dataType, "elementType", f.dataType)
            yield from paths(inner, f"{prefix}{f.name}.") if hasattr(inner, "fields") else [prefix + f.name]

    left = ",".join(p for p in paths(out.schema) if p != "page_id")
    return out.select("page_id", "url", F.lit(left).alias("fields"), "page.title", F.array_join("page.items.alt", ",").alias("alts"))


def nested_orders(spark, d):
    """Orders in the shape of a provider record; arrays are built inside the row."""
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")

    def platform(name, minimum):
        return F.struct(name.alias("name"), minimum.alias("minimum"))

    none = F.lit(None).cast("string")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    platforms = F.array(platform(priority, day), platform(F.when(status != "F", F.concat(F.lit("Status "), status)), none))
    empty = F.array().cast("array<struct<name:string,minimum:string>>")
    price = F.floor(F.col("o_totalprice")).cast("string")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("name"),
        F.when(status == "P", F.lit("soon")).otherwise(day).alias("released"),
        F.when(status == "P", empty).otherwise(platforms).alias("platforms"),
        F.array(F.struct(priority.alias("name")), F.struct(F.lit("Clerk").alias("name"))).alias("parent_platforms"),
        F.array(*[F.struct(g.alias("name")) for g in (F.lower(priority), F.upper(priority), none, status, F.lower(status))]).alias("genres"),
        F.concat(F.lit("Placed by "), "o_custkey").alias("description"),
        F.array(*[F.struct(g.alias("name")) for g in (priority, F.upper(priority), F.lit(""))]).alias("developers"),
        F.when(status != "P", F.array(*[F.struct(g.alias("name")) for g in (status, F.lit("Clerk"), none)])).alias("publishers"),
        F.array(*[F.struct(g.alias("name"), F.lit(x).alias("language")) for g, x in (
            (priority, "eng"), (status, "rus"), (none, "eng"), (F.lit("Clerk"), "eng"))]).alias("tags"),
        F.array(*[F.struct(F.lit(x).alias("title"), p.alias("percent"), n.alias("count")) for x, p, n in (
            ("high", price, F.col("o_custkey").cast("string")), ("low", F.lit("n/a"), none))]).alias("shares"),
        F.struct(F.when(status == "P", F.lit("n/a")).otherwise(price).alias("average"), price.alias("critic")).alias("ratings"),
        F.array(*[F.struct(F.lit(t).alias("title"), s.alias("score"), when.alias("publish_date"), long.alias("review_text"), short.alias("body"))
                  for t, s, when, long, short in (
            ("a", price, day, priority, status), ("b", F.col("o_custkey").cast("string"), F.lit("soon"), none, status),
            ("c", F.lit("7.5"), none, F.lit(""), priority), ("d", F.lit("tbd"), day, none, none))]).alias("reviews"),
        F.when(status != "P", F.array(F.struct(
            F.concat(F.lit("On "), priority).alias("title"), day.alias("publish_date"), F.lit("deck").alias("deck"), status.alias("body")))).alias("articles"),
    )


@query("flatten_source_record", """
SELECT o_orderkey AS game_id, 'Order ' || o_orderkey AS title, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS release_date,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS release_year, lower(o_orderpriority) || ',' || o_orderstatus AS genres,
  CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice) END AS average_rating, CAST(floor(o_totalprice) AS INTEGER) AS critic_score, o_orderstatus <> 'P' AS has_platform_specs,
  'Placed by ' || o_custkey AS description, o_orderpriority AS developers, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus || ',Clerk' ELSE '' END AS publishers,
  o_orderpriority || ',Clerk' AS tags, 'high:' || CAST(floor(o_totalprice) AS BIGINT) || ':' || o_custkey || ',low:?:?' AS rating_shares FROM orders""")
def flatten_source_record(spark, d):
    flat = ingest.flatten_record(nested_orders(spark, d))
    shares = F.transform("rating_shares", lambda r: F.concat_ws(
        ":", r["label"], F.coalesce(r["percent"].cast("bigint").cast("string"), F.lit("?")), F.coalesce(r["count"].cast("string"), F.lit("?"))))
    return flat.withColumn("rating_shares", F.array_join(shares, ","))


OWNER = S.uuid5("'order-' || o_orderkey", C.ENTITY_NAMESPACE)


@query("explode_child_specs", f"""
WITH o AS (SELECT *, {OWNER} AS owner, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
c AS (SELECT o_orderkey AS game_id, owner, o_orderpriority AS platform_name, o_orderpriority AS platform_family, day AS minimum FROM o WHERE o_orderstatus <> 'P'
  UNION ALL SELECT o_orderkey, owner, 'Status ' || o_orderstatus, NULL, NULL FROM o WHERE o_orderstatus NOT IN ('P', 'F')
  UNION ALL SELECT o_orderkey, owner, unnest([o_orderpriority, 'Clerk']) AS n, n, NULL FROM o WHERE o_orderstatus = 'P'),
k AS (SELECT *, owner || '_' || platform_name AS seed FROM c)
SELECT game_id, {S.uuid5('seed', C.ENTITY_NAMESPACE)} AS uuid, platform_name, platform_family, minimum FROM k""")
def explode_child_specs(spark, d):
    owner = keys.uuid5(F.concat(F.lit("order-"), "id"), C.ENTITY_NAMESPACE)
    return ingest.child_specs(nested_orders(spark, d), owner)


@query("review_summary", """
WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT o_orderkey AS game_id, round((floor(o_totalprice) + o_custkey + 7.5) / 3, 2) AS average_score, 4 AS items, 'a,b,c,d' AS titles,
  CAST(floor(o_totalprice) AS BIGINT) || ',' || o_custkey || ',7.5,tbd' AS scores, day || ',?,?,' || day AS dates,
  o_orderpriority || ',' || o_orderstatus || ',' || o_orderpriority || ',?' AS bodies,
  CASE WHEN o_orderstatus <> 'P' THEN 'On ' || o_orderpriority || '|' || day || '|deck|' || o_orderstatus ELSE '' END AS articles FROM o""")
def review_summary(spark, d):
    out = ingest.review_summary(nested_orders(spark, d), ["id"])

    def joined(c):
        return F.array_join(c, ",", "?")

    lines = F.transform("articles", lambda a: F.concat_ws("|", a["title"], a["date"].cast("string"), a["deck"], a["body"]))
    return out.select(
        F.col("id").cast("bigint").alias("game_id"), "average_score", F.size("items").alias("items"), joined("items.title").alias("titles"),
        joined("items.score").alias("scores"), joined(F.transform("items", lambda i: i["date"].cast("string"))).alias("dates"),
        joined("items.body").alias("bodies"), F.array_join(lines, ",").alias("articles"))


@query("enrich_or_append_child", """
WITH c AS (SELECT DISTINCT l_orderkey AS game_id, l_linenumber AS line, l_partkey AS part, CASE l_returnflag WHEN 'A' THEN ' PC ' WHEN 'N' THEN 'Windows' ELSE 'Console' END AS platform,
    CASE WHEN l_linestatus = 'O' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS day FROM lineitem),
x AS (SELECT o_orderkey AS game_id, CASE o_orderstatus WHEN 'F' THEN o_orderpriority END AS lo, CASE o_orderstatus WHEN 'O' THEN upper(o_orderpriority) WHEN 'P' THEN '' END AS hi,
    CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS xday FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT game_id, min((line, part, platform, day)) AS k FROM c WHERE lower(trim(platform)) IN ('pc', 'windows') GROUP BY 1),
j AS (SELECT c.*, lo, hi, xday, coalesce(f.k = (c.line, c.part, c.platform, c.day), FALSE) AND x.game_id IS NOT NULL AS hit FROM c LEFT JOIN f USING (game_id) LEFT JOIN x USING (game_id))
SELECT game_id, line, part, platform, CAST(NULL AS VARCHAR) AS platform_family, coalesce(nullif(day, ''), CASE WHEN hit THEN xday END) AS release_date,
  CASE WHEN hit THEN lo END AS requirements_minimum, CASE WHEN hit THEN hi END AS requirements_recommended, FALSE AS added FROM j
UNION ALL SELECT game_id, NULL, NULL, 'PC', 'PC', xday, lo, hi, TRUE FROM x WHERE game_id NOT IN (SELECT game_id FROM f)""")
def enrich_or_append_child(spark, d):
    name = F.when(F.col("l_returnflag") == "A", " PC ").when(F.col("l_returnflag") == "N", "Windows").otherwise("Console")
    shipped = F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("")
    children = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), name.alias("platform"),
        shipped.alias("day")).distinct().withColumn("release_date", F.col("day")).withColumn("platform_family", F.lit(None).cast("string"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    extra = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.when(status == "F", priority).alias("requirements_minimum"),
        F.when(status == "O", F.upper(priority)).when(status == "P", "").alias("requirements_recommended"),
        F.when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("release_date"))
    return ingest.enrich_or_append(children, extra, "game_id", ["line", "part", "platform", "day"], "platform").drop("day")


KINDS = {"STANDARD": 0, "ECONOMY": 1, "MEDIUM": 2, "LARGE": 3, "SMALL": 4, "PROMO": 14}


@query("classify_category", f"""
WITH k AS (SELECT p_partkey, CASE p_type {' '.join(f"WHEN '{n}' THEN {v}" for n, v in KINDS.items())} END AS kind, p_size > 20 AS parent, p_size BETWEEN 15 AND 30 AS version FROM part)
SELECT p_partkey, CASE WHEN kind = 0 AND NOT parent AND NOT version THEN 'Main_Game_Table' WHEN kind = 0 AND version THEN 'Edition_Table'
  WHEN kind IN (1, 2) AND parent THEN 'Expansion_Table' WHEN kind = 14 AND parent THEN 'Update_Table' WHEN kind = 3 THEN 'Bundle_Table'
  WHEN kind = 4 THEN 'Standalone_Experience_Table' ELSE 'Unclassified' END AS entity_category FROM k""")
def classify_category(spark, d):
    kind = F.coalesce(*[F.when(F.col("p_type") == n, v) for n, v in KINDS.items()])
    parent = F.when(F.col("p_size") > 20, F.col("p_size")).otherwise(0)
    version = F.when(F.col("p_size").between(15, 30), F.col("p_size"))
    def build():
        return table(spark, d, "part").withColumn("entity_category", ingest.category(kind, parent, version))

    # a folder per category, written in one go
    return stored(spark, d, "categories", ["part"], build, split_by="entity_category").select("p_partkey", "entity_category")


@query("editorial_articles", f"""
WITH b AS (SELECT doc_id, source, text AS about, CASE WHEN lang = 'en' THEN text ELSE lower(text) END AS detailed FROM documents),
a AS (SELECT doc_id, source || ' — About' AS title, about AS body, about FROM b WHERE about <> ''
  UNION ALL SELECT doc_id, source || ' — Description', detailed, about FROM b WHERE detailed <> '' AND detailed <> about)
SELECT doc_id, title, sha256(body) AS body_hash, sha256(substr(about, 1, {C.SUMMARY_CHARS})) AS summary_hash FROM a""")
def editorial_articles(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id").select(
        "doc_id", "source", F.col("text").alias("about"), F.when(F.col("lang") == "en", F.col("text")).otherwise(F.lower("text")).alias("detailed"))
    out = ingest.articles(docs, "about", "detailed", "source", ["doc_id"])
    return out.select("doc_id", "title", F.sha2("body", 256).alias("body_hash"), F.sha2("summary", 256).alias("summary_hash"))


@query("best_match_ladder", f"""
WITH q AS (SELECT DISTINCT p_name AS query, split_part(p_name, ' ', 1) AS word, 1990 + length(p_name) AS year_hint FROM part),
r AS (SELECT p_partkey AS record_id, CASE p_type WHEN 'ECONOMY' THEN 'Deluxe ' || p_name WHEN 'PROMO' THEN p_name || ' Plus' ELSE 'The ' || p_name END AS name,
  split_part(p_name, ' ', 1) AS word, CASE WHEN p_size <> 7 THEN make_date(1990 + p_size, 1 + p_size // 5, 1) END AS released, p_partkey AS pos FROM part),
j AS (SELECT *, CASE WHEN {S.slug('name')} = {S.slug('query')} THEN 1 WHEN starts_with({S.slug('name')}, {S.slug('query')}) THEN 2 ELSE 3 END AS tier FROM r JOIN q USING (word)),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, CASE WHEN tier < 3 AND year(released) = year_hint THEN 0 ELSE 1 END,
  CASE WHEN tier < 3 THEN coalesce(released, DATE '9999-12-31') END, pos) AS rn FROM j)
SELECT query, record_id, tier FROM o WHERE rn = 1""")
def best_match_ladder(spark, d):
    part = spread(table(spark, d, "part"), "p_partkey")
    word = F.element_at(F.split("p_name", " "), 1)
    asked = part.select(F.col("p_name").alias("query")).distinct()
    asked = asked.select("query", F.element_at(F.split("query", " "), 1).alias("word"), (F.length("query") + 1990).alias("year_hint"))
    name = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Deluxe "), "p_name"))
        .when(F.col("p_type") == "PROMO", F.concat("p_name", F.lit(" Plus"))).otherwise(F.concat(F.lit("The "), "p_name")))
    released = F.when(F.col("p_size") != 7, F.make_date(F.col("p_size") + 1990, F.floor(F.col("p_size") / 5).cast("int") + 1, F.lit(1)))
    records = part.select(F.col("p_partkey").alias("record_id"), name.alias("name"), word.alias("word"), released.alias("released"), F.col("p_partkey").alias("pos"))
    return ingest.best_match(asked, records, ["word"])


@query("provider_fallback", """
SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'primary' WHEN n_regionkey < 3 THEN 'secondary' ELSE 'listing' END AS source,
  CASE WHEN s_acctbal > 5000 THEN s_name WHEN n_regionkey < 3 THEN n_name ELSE 'Supplier' END AS title FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def provider_fallback(spark, d):
    supplier = table(spark, d, "supplier")
    nation = table(spark, d, "nation").where("n_regionkey < 3")
    primary = supplier.select("s_suppkey", F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("title"))
    secondary = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", F.col("n_name").alias("title"))
    listing = supplier.select("s_suppkey", F.lit("Supplier").alias("title"))
    return ingest.first_provider([("primary", primary), ("secondary", secondary), ("listing", listing)], "s_suppkey", "title")


@query("union_all_sources", """
SELECT 'editorial' AS provider, doc_id AS id, lang, NULL AS url, length(text) AS chars FROM documents
UNION ALL SELECT 'web', page_id, NULL, url, length(html) FROM pages
UNION ALL SELECT 'chat', conv_id, NULL, NULL, length(text) FROM conversations""")
def union_all_sources(spark, d):
    """Providers with different columns; one with no rows adds nothing."""
    docs = table(spark, d, "documents")
    parts = {
        "editorial": docs.select(F.col("doc_id").alias("id"), "lang", F.length("text").cast("bigint").alias("chars")),
        "empty": docs.where("lang = 'none'").select(F.col("doc_id").alias("id"), "lang", F.length("text").cast("bigint").alias("chars")),
        "web": table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.length("html").cast("bigint").alias("chars")),
        "chat": table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.length("text").cast("bigint").alias("chars")),
    }
    out = None
    for name, rows in parts.items():
        tagged = rows.withColumn("provider", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.select("provider", "id", "lang", "url", "chars")


@query("dim_lookup_default", """
SELECT row_id, dim_id, coalesce(n_name, 'Platform ' || dim_id) AS name FROM (SELECT c_custkey AS row_id, unnest([c_nationkey, c_nationkey + 5]) AS dim_id FROM customer)
LEFT JOIN nation ON n_nationkey = dim_id""")
def dim_lookup_default(spark, d):
    ids = F.array(F.col("c_nationkey"), F.col("c_nationkey") + 5)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.explode(ids).alias("dim_id"))
    dim = table(spark, d, "nation").select(F.col("n_nationkey").alias("dim_id"), "n_name")
    return rows.join(dim, "dim_id", "left").select(
        "row_id", "dim_id", F.coalesce("n_name", F.concat(F.lit("Platform "), F.col("dim_id").cast("string"))).alias("name"))
