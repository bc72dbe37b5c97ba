"""Ordering, de-duplication and packing of evidence, per query.

Groups are candidate lists a top-k has already bounded, never raw data keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text
from ..functions.numbers import rounded


def relevance(group: list[str]) -> Column:
    """Rerank score if every row of the list has one, else the retrieval score."""
    w = Window.partitionBy(*group)
    whole = F.min(F.col("rerank_score").isNotNull().cast("int")).over(w) == 1
    return F.when(whole, F.col("rerank_score")).otherwise(F.coalesce("score", F.lit(0.0)))


def _ranked(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def relevance_order(rows: DataFrame, group: list[str]) -> DataFrame:
    scored = rows.withColumn("_rel", relevance(group))
    return _ranked(scored, group, [F.desc("_rel"), F.asc("pos")]).drop("_rel")


def comparison_order(rows: DataFrame, group: list[str]) -> DataFrame:
    """The best row of each entity, then general rows, then the remainder."""
    entity = F.when(~F.coalesce("retrieval_context", F.lit("")).isin("", "fallback"), F.col("retrieval_context"))
    scored = rows.withColumn("_rel", relevance(group)).withColumn("_entity", entity)
    mine = Window.partitionBy(*group, "_entity")
    scored = scored.withColumn("_nth", F.row_number().over(mine.orderBy(F.desc("_rel"), F.asc("pos"))))
    scored = scored.withColumn("_seen", F.min("pos").over(mine))
    general = F.col("_entity").isNull()
    band = F.when(general, 1).when(F.col("_nth") == 1, 0).otherwise(2)
    # the remainder is collected entity by entity before it is sorted, so ties keep that order
    first = F.when(band == 0, F.col("_seen")).otherwise(0)
    rel = F.when(band == 0, 0.0).otherwise(-F.col("_rel"))
    tie = F.when(band == 2, F.col("_seen")).otherwise(0)
    out = _ranked(scored, group, [band, first, rel, tie, F.col("_nth"), F.col("pos")])
    return out.drop("_rel", "_entity", "_nth", "_seen")


def list_order(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows with an index first and by it, the others by relevance among themselves."""
    indexed = F.coalesce(F.col("chunk_index") >= 0, F.lit(False))
    scored = rows.withColumn("_indexed", indexed).withColumn("_rel", relevance([*group, "_indexed"]))
    order = [
        F.desc("_indexed"), F.when(F.col("_indexed"), F.col("chunk_index")).asc_nulls_last(),
        F.when(F.col("_indexed"), 0.0).otherwise(-F.col("_rel")), F.asc("pos"),
    ]
    return _ranked(scored, group, order).drop("_indexed", "_rel")


def dedupe_longest(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row per title and normalised content: the longest, at the first position."""
    full = rows.where(~text.blank(F.col("content")))
    norm = F.array_join(text.compare_tokens(F.col("content")), " ")
    key = F.sha2(F.concat_ws("::", text.strip(F.coalesce("source_title", F.lit(""))), norm), 256)
    rest = [c for c in rows.columns if c not in (*group, "pos")]
    best = F.max_by(F.struct(*rest), F.struct(F.length("content"), -F.col("pos")))
    out = full.withColumn("_key", key).groupBy(*group, "_key").agg(F.min("pos").alias("pos"), best.alias("row"))
    return out.select(*group, "pos", "row.*")


def drop_contained(rows: DataFrame, group: list[str]) -> DataFrame:
    """Drop content that a longer row of the same kind of source contains."""
    kind = F.coalesce("source_type", F.lit("local"))
    a = rows.withColumn("_kind", kind)
    b = a.select(*group, "_kind", F.col("content").alias("_longer")).where(F.col("_longer").isNotNull())
    same = [a[g] == b[g] for g in (*group, "_kind")]
    inside = (F.length(b["_longer"]) > F.length(a["content"])) & b["_longer"].contains(a["content"])
    cond = inside
    for s in same:
        cond = cond & s
    return a.join(b, cond, "left_anti").drop("_kind")


def merge_first(groups: list[DataFrame]) -> DataFrame:
    """Union of ranked groups; each content once per query, where it came first."""
    union = None
    for no, rows in enumerate(groups):
        part = rows.withColumn("_group", F.lit(no))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    first = F.min(F.struct("_group", "pos"))
    out = union.groupBy("query_id", "content").agg(first.alias("at"))
    order = Window.partitionBy("query_id").orderBy("at._group", "at.pos")
    return out.select("query_id", F.row_number().over(order).alias("pos"), "content")


def budget_pack(rows: DataFrame, group: list[str], cap: int = C.CONTEXT_CHARS) -> DataFrame:
    """Greedy packing in rank order, as one fold over each query's ordered list.

    A row is left out when it is empty, would break the cap, or shares half of
    its tokens with a row already taken; only the last case counts as redundant.
    """
    item = F.struct("rank", "chunk_uuid", text.strip(F.coalesce("content", F.lit(""))).alias("content"))
    lists = rows.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    ready = F.transform("items", lambda x: F.struct(
        x["rank"].alias("rank"), x["chunk_uuid"].alias("chunk_uuid"),
        F.length(x["content"]).alias("chars"), text.compare_set(x["content"]).alias("toks")))
    start = F.from_json(
        F.lit('{"used":0,"redundant":0,"kept":[]}'),
        "used INT, redundant INT, kept ARRAY<STRUCT<rank: INT, chunk_uuid: STRING, used: INT, toks: ARRAY<STRING>>>",
    )

    def step(acc: Column, x: Column) -> Column:
        def close(k: Column) -> Column:
            return F.size(F.array_intersect(k["toks"], x["toks"])) >= C.JACCARD_LIMIT * F.size(F.array_union(k["toks"], x["toks"]))

        over = (x["chars"] == 0) | (acc["used"] + x["chars"] > cap)
        same = (F.size(x["toks"]) == 0) | F.exists(acc["kept"], close)
        taken = F.struct(x["rank"].alias("rank"), x["chunk_uuid"].alias("chunk_uuid"),
                         (acc["used"] + x["chars"]).alias("used"), x["toks"].alias("toks"))
        return (
            F.when(over, acc)
            .when(same, F.struct(acc["used"].alias("used"), (acc["redundant"] + 1).alias("redundant"), acc["kept"].alias("kept")))
            .otherwise(F.struct((acc["used"] + x["chars"]).alias("used"), acc["redundant"].alias("redundant"),
                                F.array_append(acc["kept"], taken).alias("kept")))
        )

    packed = lists.select(*group, F.size("items").alias("n_in"), ready.alias("items"))
    packed = packed.select(*group, "n_in", F.aggregate("items", start, step).alias("p"))
    return packed.select(*group, "n_in", F.col("p.redundant").alias("redundant"), F.col("p.kept").alias("kept"))


def packed_rows(packed: DataFrame, group: list[str]) -> DataFrame:
    one = packed.select(*group, "redundant", F.posexplode("kept").alias("n", "k"))
    return one.select(*group, (F.col("n") + 1).alias("rank"), "k.chunk_uuid", F.col("k.used").alias("used_chars"), "redundant")


def near_duplicates(rows: DataFrame) -> DataFrame:
    """Pairs inside each bounded candidate list whose token sets overlap by half."""
    toks = rows.select("query_id", "pos", "chunk_uuid", text.compare_set(F.col("content")).alias("toks"))
    lists = toks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_uuid", "toks"))).alias("items"))

    def against(x: Column) -> Column:
        def score(y: Column) -> Column:
            both = F.size(F.array_intersect(x["toks"], y["toks"]))
            return F.struct(x["chunk_uuid"].alias("id_a"), y["chunk_uuid"].alias("id_b"),
                            (both / F.size(F.array_union(x["toks"], y["toks"]))).alias("jaccard"))

        later = F.filter("items", lambda y: y["pos"] > x["pos"])
        return F.filter(F.transform(later, score), lambda s: s["jaccard"] >= C.JACCARD_LIMIT)

    pairs = lists.select("query_id", F.explode(F.flatten(F.transform("items", against))).alias("p"))
    return pairs.select("query_id", "p.id_a", "p.id_b", rounded(F.col("p.jaccard"), 6).alias("jaccard"))


def prompt_ladder(chunks: DataFrame, group: list[str], size: str, verbose: int, concise: int, cap: int = C.PROMPT_CHARS) -> DataFrame:
    """Longest prefix of the packed chunks that fits, and which wording it forces.

    A group without chunks is one row with a NULL rank and size.  Only an empty prompt that is
    itself too long is minimal.
    """
    upto = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = chunks.withColumn("_upto", F.sum(size).over(upto))
    per = sized.groupBy(*group).agg(
        F.coalesce(F.max("_upto"), F.lit(0)).alias("total"), F.count("rank").alias("n"),
        F.count_if(F.col("_upto") + concise <= cap).alias("fits"))
    mode = (
        F.when(F.col("total") + verbose <= cap, "verbose").when(F.col("total") + concise <= cap, "concise")
        .when(F.lit(concise <= cap), "truncated").otherwise("minimal")
    )
    used = F.when(mode.isin("verbose", "concise"), F.col("n")).otherwise(F.col("fits"))
    return per.select(*group, mode.alias("mode"), used.alias("chunks_used"))
