"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets are water-filled up to a number of repeats.  The corpus is worth a whole number of blocks
of ``BLOCK`` words; sources win them by the highest quotients target / (2k + 1), then each source's
shards win the source's blocks by the same rule.  A shard lays its documents end to end in seeded
order, as a ring; its blocks are taken from a seeded start onwards, so documents stay whole except
at the two ends of the run.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialize, running
from .words import count_words, split_words

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 32
#: Words per shard: bounds what one task orders, whatever the size of a source.
SHARD_WORDS = 1 << 15


def seeded(value: Column, seed: int) -> Column:
    """60 bits of an MD5, the same in every SQL engine."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("bigint")


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds ``rank`` and ``target`` to one row per source (source_key, source_size).

    Sources by code point, NULL (key '') last, take the weights in turn.  The level at which the
    targets meet the total is the largest of (rest of the total) / (rest of the weights) over the
    sources in rising order of cap / weight.
    """
    ranked = running(sources, [F.col("source_key") == "", F.col("source_key")], {"rank": F.lit(1)})
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    cap = F.col("source_size") * repeats
    filled = running(
        weighed, [cap / F.col("weight"), F.col("rank")], {"used": cap, "weight_used": F.col("weight")}
    )
    filled = materialize(filled, "targets")
    total, whole = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total) - F.col("used")) / (F.lit(whole) - F.col("weight_used"))
    best = filled.agg(F.max(level)).first()[0] if total else 0.0
    return filled.withColumn("target", F.least(cap.cast("double"), F.lit(float(best)) * F.col("weight"))).drop(
        "used", "weight_used", "weight"
    )


def sainte_lague(units: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (group, unit, seats): the seats of each group go to its highest quotients.

    ``units`` has group, unit, weight and ``place`` (decides ties, unique in a group), ``groups``
    has group and seats.  With the divisors that give n/2 + 1 seats too few and too many for n
    units, the winners below the first are certain; only about two quotients per unit are left to
    rank.  A group without weight gets no seats.
    """
    sums = units.groupBy("group").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    met = units.join(sums.where("w > 0").join(groups, "group"), "group")

    def seats_at(share: Column) -> Column:
        return F.floor(F.greatest(share, F.lit(0.0)) * F.col("weight") / F.col("w") + 0.5)

    sure = materialize(
        met.withColumn("low", seats_at(F.col("seats") - F.col("n") / 2 - 1)).withColumn(
            "high", F.greatest(seats_at(F.col("seats") + F.col("n") / 2 + 1), F.col("low"))
        ),
        "quotients",
    )
    open_seats = sure.groupBy("group").agg((F.first("seats") - F.sum("low")).alias("open"))
    asked = (
        sure.where("high > low and weight > 0")
        .select("group", "unit", "place", "weight", F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
        .select("group", "unit", "place", (F.col("weight") / (2 * F.col("k") + 1)).alias("quotient"))
    )
    order = [F.col("group"), F.col("quotient").desc(), F.col("place"), F.col("unit")]
    ranked = materialize(running(asked, order, {"position": F.lit(1)}), "ranked")
    first = ranked.groupBy("group").agg(F.min("position").alias("first"))
    won = (
        ranked.join(first.join(open_seats, "group"), "group")
        .where(F.col("position") - F.col("first") < F.col("open"))
        .groupBy("group", "unit")
        .agg(F.count("*").alias("won"))
    )
    return sure.join(won, ["group", "unit"], "left").select(
        "group", "unit", (F.col("low") + F.coalesce("won", F.lit(0))).cast("bigint").alias("seats")
    )


def overlap(start: Column, end: Column, a: Column, b: Column) -> Column:
    return F.greatest(F.least(end, b) - F.greatest(start, a), F.lit(0))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = 11,
) -> DataFrame:
    """The columns of ``docs`` under ``doc``, with size, source_size, target and what is taken.

    ``taken`` words in all; ``copies`` whole passes, and up to two pieces ``from_1:to_1`` and
    ``from_2:to_2`` in words of the document.  NULL and blank texts have size 0 and are never
    taken; NULL sources come last; repeated rows are separate documents; no rows give none.
    Ties of the seeded order are broken by doc_id and size, so reruns agree.
    """
    measured = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("bigint").alias("id"),
        source_key().alias("source_key"), count_words(F.col("text").cast("string")).alias("size"),
        seeded(F.col("doc_id"), seed).alias("order"),
    )
    narrow = materialize(measured.select("source_key", "size", "order"), "sizes")
    sources = targets(
        materialize(narrow.groupBy("source_key").agg(F.sum("size").alias("source_size")), "sources"), weights, repeats
    ).withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)))
    sources = materialize(sources, "mix")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    blocks = total // block + (1 if 2 * (total % block) >= block else 0)

    shard = F.pmod(F.col("order"), F.col("shards")).alias("shard")
    shards = materialize(
        narrow.join(sources, "source_key").select("source_key", shard, "size")
        .groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size")),
        "shards",
    )
    spark = docs.sparkSession
    everything = spark.range(1).select(F.lit("").alias("group"), F.lit(blocks).cast("bigint").alias("seats"))
    per_source = sainte_lague(
        sources.select(
            F.lit("").alias("group"), F.col("source_key").alias("unit"), F.col("target").alias("weight"),
            F.col("rank").alias("place"),
        ),
        everything,
    )
    per_shard = sainte_lague(
        shards.select(
            F.col("source_key").alias("group"), F.col("shard").alias("unit"),
            F.col("shard_size").cast("double").alias("weight"), F.col("shard").alias("place"),
        ),
        per_source.select(F.col("unit").alias("group"), "seats"),
    )
    words = F.least(F.coalesce(F.col("seats"), F.lit(0)) * block, F.col("shard_size") * repeats)
    begins = F.pmod(
        seeded(F.concat_ws("/", "source_key", "shard"), seed), F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1))
    )
    quotas = materialize(
        shards.join(
            per_shard.select(F.col("group").alias("source_key"), F.col("unit").alias("shard"), "seats"),
            ["source_key", "shard"], "left",
        ).select("source_key", "shard", "shard_size", words.alias("words"), (begins * block).alias("begins")),
        "quotas",
    )
    ring = Window.partitionBy("source_key", "shard").orderBy("order", "id", "size")
    before = F.coalesce(F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        measured.join(sources.select("source_key", "source_size", "target", "shards"), "source_key")
        .select("doc", "id", "size", "order", "source_size", "target", "source_key", shard)
        .join(quotas, ["source_key", "shard"])
        .withColumn("at", before)
    )
    full = F.floor(F.col("words") / F.greatest(F.col("shard_size"), F.lit(1))).cast("bigint")
    rest = F.col("words") - full * F.col("shard_size")
    a, b = F.col("at"), F.col("at") + F.col("size")
    stop = F.col("begins") + rest
    wrapped = stop - F.col("shard_size")
    pieces = placed.select(
        "doc", F.col("id").alias("doc_id"), "size", "source_size", "target", full.alias("copies"),
        (F.greatest(F.col("begins"), a) - a).alias("from_1"),
        (F.greatest(F.col("begins"), a) - a + overlap(F.col("begins"), stop, a, b)).alias("to_1"),
        F.lit(0).cast("bigint").alias("from_2"), overlap(F.lit(0), wrapped, a, b).cast("bigint").alias("to_2"),
    )
    taken = F.col("copies") * F.col("size") + F.col("to_1") - F.col("from_1") + F.col("to_2")
    return pieces.withColumn("taken", taken.cast("bigint"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per copy and per piece taken.

    A piece that is the whole document keeps its text as it is; another one is its words, joined
    by single spaces.  A column n_chars, where there is one, follows the text.
    """
    chosen = mix(docs, **options)
    whole = F.expr("struct(cast(0 as bigint) as a, size as b)")
    parts = F.concat(
        F.array_repeat(whole, F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("int")),
        F.filter(
            F.array(
                F.struct(F.col("from_1").alias("a"), F.col("to_1").alias("b")),
                F.struct(F.col("from_2").alias("a"), F.col("to_2").alias("b")),
            ),
            lambda p: p["b"] > p["a"],
        ),
    )
    rows = chosen.where("taken > 0").select("doc", "size", F.explode(parts).alias("part"))
    text = F.col("doc.text")
    cut = F.array_join(
        F.slice(split_words(text), (F.col("part.a") + 1).cast("int"), (F.col("part.b") - F.col("part.a")).cast("int")), " "
    )
    new_text = F.when(F.col("part.b") - F.col("part.a") == F.col("size"), text).otherwise(cut)
    rows = rows.select("doc", new_text.alias("text"))
    out = []
    for c, kind in docs.dtypes:
        if c == "text":
            out.append(F.col("text"))
        elif c == "n_chars":
            out.append(F.length("text").cast(kind).alias(c))
        else:
            out.append(F.col(f"doc.`{c}`").alias(c))
    return rows.select(*out)
