"""Corpus integrity and vector drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.ranking import ordered_stats
from ..sources.tables import materialize


# ---------------------------------------------------------------- vectors

def norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(vec: str) -> Column:
    """Unit vector; a zero vector stays zero.  The norm is evaluated once, not per element."""
    norms = F.array_repeat(norm(vec), F.size(vec))
    return F.zip_with(vec, norms, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def mean_vector(units: DataFrame, vec: str, dim: int) -> DataFrame:
    """One row with the element-wise mean: dim plain averages, combined map-side."""
    return units.agg(F.array(*[F.avg(F.col(vec)[i]) for i in range(dim)]).alias("centroid"))


def centroid_split(vectors: DataFrame, vec: str, dim: int, min_gap: float = C.DRIFT_GAP) -> DataFrame:
    """(id, cosine, side): cosine to the centroid, split at the widest gap.

    Without a gap of ``min_gap`` nothing is split and every side is NULL.
    """
    units = vectors.select("id", unit(vec).alias("u"))
    centroid = mean_vector(units, "u", dim).select(unit("centroid")).scalar()
    scored = materialize(
        units.withColumn("c", centroid).select("id", F.round(dot("u", "c"), 6).alias("cosine")), "cosine")
    per = scored.groupBy("cosine").agg(F.count("*").alias("n"))
    steps = ordered_stats(per, "cosine", ["n"]).where("next_cosine IS NOT NULL")
    gap = F.round(F.col("next_cosine") - F.col("cosine"), 6)
    widest = steps.agg(F.max_by(F.struct(gap.alias("gap"), F.col("cosine").alias("low")), F.struct(gap, -F.col("cosine")))).scalar()
    cut = scored.withColumn("w", widest)
    side = F.when(F.col("w.gap") >= min_gap, F.when(F.col("cosine") <= F.col("w.low"), "low").otherwise("high"))
    return cut.select("id", "cosine", side.alias("side"))


def migrated_side(clusters: DataFrame, stored: DataFrame, fresh: DataFrame, sample: int = C.DRIFT_SAMPLE) -> DataFrame:
    """Which of two clusters agrees with fresh vectors, judged on a small sample of each.

    clusters: (side, rank, id) holding the sampled ids; stored, fresh: (id, vec).
    """
    picked = clusters.where(F.col("rank") <= sample)
    both = (
        picked.join(stored.select("id", unit("vec").alias("s")), "id")
        .join(fresh.select("id", unit("vec").alias("f")), "id")
    )
    per = both.groupBy("side").agg(F.round(F.avg(dot("s", "f")), 6).alias("mean_cosine"))
    best = per.agg(F.max_by("side", F.struct("mean_cosine", "side"))).scalar()
    return per.select("side", "mean_cosine", (F.col("side") == best).alias("migrated"))


def migrated_side_by(clusters: DataFrame, stored: DataFrame, texts: DataFrame, embed: Callable[[Column], Column],
                     sample: int = C.DRIFT_SAMPLE) -> DataFrame:
    """As ``migrated_side``, with the fresh vectors made by ``embed``, say a pandas UDF from text to array<float>.

    Only the sampled texts (id, text) are embedded.
    """
    picked = clusters.where(F.col("rank") <= sample)
    fresh = texts.join(picked.select("id").distinct(), "id").select("id", embed(F.col("text")).alias("vec"))
    return migrated_side(clusters, stored, fresh, sample)


# ---------------------------------------------------------------- keys

def present(key: str) -> Column:
    """A key that is there; an empty string is none."""
    return F.coalesce(F.col(key).cast("string") != "", F.lit(False))


def orphan_reason(children: DataFrame, parents: DataFrame, key: str, second: str) -> DataFrame:
    """Children without their keys or without a parent, with the first reason.

    Only children with both keys need the join; the others get a spread key that
    matches nothing, so that missing keys do not meet in one task.  A hot parent
    is cut up by the adaptive skew join.
    """
    known = parents.select(F.col(key).cast("string").alias("_k")).distinct().withColumn("_hit", F.lit(True))
    whole = present(key) & present(second)
    probe = F.when(whole, F.col(key).cast("string")).otherwise(F.concat(F.lit("missing-"), F.xxhash64(*children.columns).cast("string")))
    joined = children.withColumn("_k", probe).join(known, "_k", "left")
    reason = F.when(~present(key), "missing_parent").when(~present(second), "missing_second_key").when(
        F.col("_hit").isNull(), "unknown_parent")
    return joined.withColumn("reason", reason).drop("_k", "_hit")


def children_count(children: DataFrame, parents: DataFrame, key: str, second: str) -> DataFrame:
    """Children with both keys per known parent; counted first, so the join sees one row per key."""
    counts = children.where(present(key) & present(second)).groupBy(key).agg(F.count("*").alias("n"))
    return counts.join(parents.select(key).distinct(), key, "left_semi")


def childless(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents without children; children are merged to distinct keys before the shuffle."""
    return parents.join(children.select(key).distinct(), key, "left_anti")


def duplicate_members(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(key, n, member): every row of a key that several members share.

    One row per member instead of a list per key: a key with a billion copies
    stays spread out.  The counts are the small side of a salted join.
    """
    from ..functions.joins import salted_join

    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return salted_join(rows.select(key, member), counts, [key], member).select(key, "n", member)
