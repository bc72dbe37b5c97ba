"""Shaping nested provider records into flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import keys, text
from ..functions.joins import salted_join


def prune_fields(df: DataFrame, parts: list[str] = C.MEDIA_FIELDS, names: list[str] = C.MEDIA_NAMES) -> DataFrame:
    """Drop fields whose name holds one of ``parts`` or is one of ``names``, at every nesting level.

    Only the schema is walked; the rows are rebuilt by struct and transform,
    so nothing leaves the JVM and dropped leaves are never read.
    """
    def banned(name: str) -> bool:
        return name.lower() in names or any(p in name.lower() for p in parts)

    def touched(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(banned(f.name) or touched(f.dataType) for f in kind.fields)
        return isinstance(kind, T.ArrayType) and touched(kind.elementType)

    def rebuild(value: Column, kind: T.DataType) -> Column:
        if not touched(kind):
            return value
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: rebuild(x, kind.elementType))
        kept = [rebuild(value[f.name], f.dataType).alias(f.name) for f in kind.fields if not banned(f.name)]
        return F.when(value.isNotNull(), F.struct(*kept))

    return df.select(*[rebuild(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if not banned(f.name)])


def distinct_ci(values: Column) -> Column:
    """Distinct strings of an array whatever their case, first spelling and order kept."""
    return F.transform(F.sort_array(text.first_of_each(values)), lambda x: x["value"])


# Date, date and time, date and time with Z
DATE_NOTATION = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}Z?)?$"


def standard_date(value: Column) -> Column:
    """Date of the three accepted notations, else NULL; no parser exceptions on bad rows."""
    return F.when(value.rlike(DATE_NOTATION), F.to_date(value.try_cast("timestamp")))


def names_of(items: str) -> Column:
    """Non-empty names of an array of records; a missing array has none."""
    names = F.transform(F.coalesce(F.col(items), F.array().cast("array<struct<name:string>>")), lambda g: g["name"])
    return F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")


def flatten_record(df: DataFrame) -> DataFrame:
    """Nested record to one flat row with typed nullable columns; lists become comma-separated strings."""
    english = F.filter("tags", lambda t: (t["language"] == "eng") & (F.coalesce(t["name"], F.lit("")) != ""))
    shares = F.transform("shares", lambda r: F.struct(
        r["title"].alias("label"), r["percent"].try_cast("double").alias("percent"), r["count"].try_cast("int").alias("count")))
    return df.select(
        F.col("id").try_cast("bigint").alias("game_id"), F.col("name").alias("title"), "description",
        standard_date(F.col("released")).alias("release_date"),
        F.substring("released", 1, 4).try_cast("int").alias("release_year"),
        *[F.array_join(distinct_ci(names_of(c)), ",").alias(c) for c in ("genres", "developers", "publishers")],
        F.coalesce(F.array_join(F.transform(english, lambda t: t["name"]), ","), F.lit("")).alias("tags"),
        shares.alias("rating_shares"),
        F.col("ratings.average").try_cast("double").alias("average_rating"),
        F.col("ratings.critic").try_cast("int").alias("critic_score"),
        (F.coalesce(F.size("platforms"), F.lit(0)) > 0).alias("has_platform_specs"),
    )


def child_specs(df: DataFrame, owner_uuid: Column) -> DataFrame:
    """One row per named platform; without platforms the parent list stands in."""
    parents = F.filter(F.transform("parent_platforms", lambda p: p["name"]), lambda n: n.isNotNull())
    named = F.transform("platforms", lambda p: F.struct(
        p["name"].alias("platform_name"), F.when(F.array_contains(parents, p["name"]), p["name"]).alias("platform_family"),
        p["minimum"].alias("minimum")))
    fallback = F.transform(parents, lambda n: F.struct(
        n.alias("platform_name"), n.alias("platform_family"), F.lit(None).cast("string").alias("minimum")))
    rows = df.select(F.col("id").try_cast("bigint").alias("game_id"), owner_uuid.alias("owner"),
                     F.explode(F.when(F.size("platforms") > 0, named).otherwise(fallback)).alias("p"))
    rows = rows.where(F.coalesce("p.platform_name", F.lit("")) != "")
    seed = F.concat_ws("_", "owner", "p.platform_name")
    return rows.select("game_id", keys.uuid5(seed, C.ENTITY_NAMESPACE).alias("uuid"), "p.*")


def category(kind: Column, parent: Column, version: Column) -> Column:
    """Seven relational categories from type, parent and version parent; 0 counts as absent."""
    has_parent = F.coalesce(parent, F.lit(0)) != 0
    has_version = F.coalesce(version, F.lit(0)) != 0
    return (
        F.when((kind == 0) & ~has_parent & ~has_version, "Main_Game_Table")
        .when((kind == 0) & has_version, "Edition_Table")
        .when(kind.isin(1, 2) & has_parent, "Expansion_Table")
        .when((kind == 14) & has_parent, "Update_Table")
        .when(kind == 3, "Bundle_Table")
        .when(kind == 4, "Standalone_Experience_Table")
        .otherwise("Unclassified")
    )


def review_mean(reviews: Column) -> Column:
    """Mean of the numeric scores, two digits, NULL without one."""
    number = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
    numeric = F.filter(reviews, lambda r: r["score"].rlike(number))
    scores = F.transform(numeric, lambda r: r["score"].try_cast("double"))
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s)
    return F.when(F.size(scores) > 0, F.round(total / F.size(scores), 2))


def review_summary(df: DataFrame, carry: list[str]) -> DataFrame:
    """average_score, the review items with ISO dates, and the article list of every record; missing lists are empty."""
    def listed(items: str, fields: list[str]) -> Column:
        def one(x: Column) -> Column:
            text_of = F.coalesce(F.nullif(x["review_text"], F.lit("")), x["body"]) if items == "reviews" else x["body"]
            return F.struct(x["title"].alias("title"), *[x[f].alias(f) for f in fields],
                            standard_date(x["publish_date"]).alias("date"), text_of.alias("body"))

        found = F.transform(items, one)
        return F.coalesce(found, F.array().cast(df.select(found).schema[0].dataType))

    return df.select(
        *carry, review_mean(F.col("reviews")).alias("average_score"),
        listed("reviews", ["score"]).alias("items"), listed("articles", ["deck"]).alias("articles"),
    )


def articles(df: DataFrame, about: str, detailed: str, name: str, carry: list[str]) -> DataFrame:
    """Article rows of a record; a second body equal to the first is left out."""
    dash = F.lit(" — ")
    first = F.struct(F.concat(name, dash, F.lit("About")).alias("title"), F.col(about).alias("body"))
    second = F.struct(F.concat(name, dash, F.lit("Description")).alias("title"), F.col(detailed).alias("body"))
    keep_first = F.coalesce(about, F.lit("")) != ""
    keep_second = (F.coalesce(detailed, F.lit("")) != "") & ~F.col(detailed).eqNullSafe(F.col(about))
    items = F.array_compact(F.array(F.when(keep_first, first), F.when(keep_second, second)))
    rows = df.select(*carry, F.substring(F.coalesce(about, detailed), 1, C.SUMMARY_CHARS).alias("summary"), F.posexplode(items).alias("n", "a"))
    return rows.select(*carry, "n", "a.title", "a.body", "summary")


def best_match(queries: DataFrame, records: DataFrame, on: list[str]) -> DataFrame:
    """Best record per query among the records of its list ``on``: exact slug, slug prefix, else the first.

    Records with the same slug and year are reduced to the earliest first, and what is left is listed under those
    prefixes of its slug that are as long as a query of its list.  Per list, prefix, tier and year only the earliest record is
    kept, so a query meets a row per tier and year of its own slug, however many records its list has.
    """
    far = F.lit("9999-12-31").cast("date")
    known = records.select(
        *on, keys.slug(F.col("name")).alias("slug"), F.year("released").alias("year"),
        F.struct(F.coalesce(F.col("released"), far).alias("at"), "pos", "record_id").alias("row"))
    asked = queries.select("query", *on, "year_hint", keys.slug(F.col("query")).alias("prefix"))
    # a minimum of structs is sorted in the task, so it runs over a row per record and not over a row per prefix
    once = known.where("slug IS NOT NULL").groupBy(*on, "slug", "year").agg(F.min("row").alias("row"))
    # 0 is the empty prefix, which an empty query asks for
    lengths = asked.where("prefix IS NOT NULL").select(*on, F.length("prefix").alias("n")).distinct()
    spread = salted_join(once, lengths, on, "slug").where(F.col("n") <= F.length("slug"))
    tier = F.when(F.col("n") == F.length("slug"), 1).otherwise(2)
    index = spread.select(*on, F.expr("substring(slug, 1, n)").alias("prefix"), tier.alias("tier"), "year", "row")
    index = index.groupBy(*on, "prefix", "tier", "year").agg(F.min("row").alias("row"))
    first = known.groupBy(*on).agg(F.min(F.struct("row.pos", "row.record_id")).alias("first"))

    miss = F.when(F.col("year") == F.col("year_hint"), 0).otherwise(1)
    ranked = asked.join(index, [*on, "prefix"]).select("query", F.struct("tier", miss.alias("miss"), "row.at", "row.pos", "row.record_id").alias("o"))
    none = F.lit(None).cast("date")
    rest = asked.join(first, on).select("query", F.struct(
        F.lit(3).alias("tier"), F.lit(1).alias("miss"), none.alias("at"), "first.pos", "first.record_id").alias("o"))
    best = ranked.unionByName(rest).groupBy("query").agg(F.min("o").alias("b"))
    return best.select("query", "b.record_id", "b.tier")


def first_provider(providers: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """The first provider, in the given order, with a usable value per key."""
    union = None
    for no, (name, rows) in enumerate(providers):
        part = rows.where(~text.blank(F.col(value))).select(
            key, F.lit(no).alias("_no"), F.lit(name).alias("source"), value)
        union = part if union is None else union.unionByName(part)
    best = union.groupBy(key).agg(F.min_by(F.struct("source", value), "_no").alias("b"))
    return best.select(key, "b.*")


REQUIREMENTS = ["requirements_minimum", "requirements_recommended"]


def enrich_or_append(children: DataFrame, extra: DataFrame, owner: str, ident: list[str], name: str) -> DataFrame:
    """Put both requirements on the first matching child, or add a child that has them.

    extra: one row per owner with both requirements and release_date; without any requirement it changes
    nothing.  The child's own date stays, an empty one is filled.  The first match per owner is a minimum (map-side);
    it is joined back on the child's full identity, so an owner with very many children is no hot key.
    """
    given = extra.where(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in REQUIREMENTS]).isNotNull())
    match = F.lower(text.strip(F.col(name))).isin(C.PC_NAMES)
    first = children.where(match).groupBy(owner).agg(F.min(F.struct(*ident)).alias("f"))
    filled = first.join(given, owner).select(owner, "f.*", *REQUIREMENTS, F.col("release_date").alias("_date"))
    date = F.coalesce(F.nullif(F.col("release_date"), F.lit("")), "_date")
    kept = children.join(filled, [owner, *ident], "left").withColumn("release_date", date).drop("_date").withColumn("added", F.lit(False))
    new = given.join(first, owner, "left_anti").select(
        owner, F.lit("PC").alias(name), F.lit("PC").alias("platform_family"), *REQUIREMENTS, "release_date", F.lit(True).alias("added"))
    return kept.unionByName(new, allowMissingColumns=True)
