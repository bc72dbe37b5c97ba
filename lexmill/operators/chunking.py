"""From documents to overlapping word chunks with deterministic keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import keys, text


def chunk_words(
    docs: DataFrame,
    body: str,
    title: str,
    carry: list[str],
    size: int = C.CHUNK_WORDS,
    overlap: int = C.CHUNK_OVERLAP,
    rare_entities: bool = True,
) -> DataFrame:
    """One row per window of ``size`` words; windows start every size - overlap words.

    A last window that lies inside the one before it is still emitted.  The
    windows are cut before the explode, so the word array is never copied.
    """
    words = docs.select(
        *carry, F.col(title).alias("_title"),
        text.body_words(F.col(body), rare_entities).alias("_words"),
    )

    def window(start: Column) -> Column:
        # lambda bodies share nothing, so the slice is named once
        alone = F.lit(True) if size == 1 else start + 1 == F.size("_words")
        return F.when(alone, F.substring(F.element_at("_words", start + 1), 1, C.GIANT_WORD)).otherwise(
            F.array_join(F.slice("_words", start + 1, size), " "))

    # no words, no windows; a filter here would be evaluated a second time below the shuffle
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1, F.lit(size - overlap)))
    cut = words.select(*carry, "_title", F.posexplode(F.transform(starts, window)).alias("chunk_index", "_body"))
    titled = F.col("_title").isNotNull() & (F.col("_title") != "")
    content = F.when(titled, F.concat("_title", F.lit("\n\n"), "_body")).otherwise(F.col("_body"))
    return cut.select(*carry, F.col("_title").alias("source_title"), "chunk_index", content.alias("content"))


def drop_reason(content: Column) -> Column:
    """The first quality rule a chunk breaks, NULL when it is kept."""
    size = F.greatest(F.length(content), F.lit(1))
    # that many words need at least one separator each, so short chunks are never split
    long = F.length(content) > 2 * C.MAX_CHUNK_WORDS
    symbols = sum((text.occurrences(content, s) for s in C.PRICE_SYMBOLS[1:]),
                  text.occurrences(content, C.PRICE_SYMBOLS[0]))
    # one fold, because a branch evaluates every mention of the lines again
    mean = F.aggregate(
        text.lines(content), F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars")),
        lambda acc, line: F.struct((acc["n"] + 1).alias("n"), (acc["chars"] + F.length(line)).alias("chars")),
        lambda acc: F.when(acc["n"] > 0, acc["chars"] / acc["n"]))
    return (
        F.when(content.rlike(r"<[a-zA-Z/][^>]*>"), "html")
        .when(long & (F.size(text.split_words(content)) > C.MAX_CHUNK_WORDS), "oversized")
        .when(symbols / size > C.PRICE_DENSITY, "price_density")
        .when(content.isNotNull() & (F.coalesce(mean, F.lit(0.0)) < C.MIN_LINE_CHARS), "list_like")
    )


#: ``reason`` of a window that no rule drops.
KEPT = "kept"


def judged_windows(docs: DataFrame, rare_entities: bool = True) -> DataFrame:
    """Every window of every document with its key and the rule that drops it, or KEPT.

    ``row`` tells repeated rows apart; it is given by the task, so write the table before using it.
    """
    cut = chunk_words(docs, "text", "source", ["doc_id", "source", "lang"], rare_entities=rare_entities)
    return cut.select(
        F.monotonically_increasing_id().alias("row"), keys.chunk_uuid(F.col("content")).alias("chunk_uuid"), "doc_id", "chunk_index",
        "source", "lang", "source_title", "content", F.sha2("content", 256).alias("content_hash"),
        F.coalesce(drop_reason(F.col("content")), F.lit(KEPT)).alias("reason"),
    )


def later_copies(kept: DataFrame) -> DataFrame:
    """Rows whose chunk id an earlier owner has; equal text under several owners goes to the smallest.

    Only keys are read and shuffled, and the minimum combines map-side, so a text copied a billion times leaves
    each map task once.
    """
    place = F.struct("doc_id", "chunk_index", "row")
    first = kept.groupBy("chunk_uuid").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return kept.join(first, "chunk_uuid").where(F.col("row") != F.col("first.row")).select("row")


def chunks_from(windows: DataFrame, copies: DataFrame) -> DataFrame:
    """Stored chunks: the kept windows without later copies; texts stay where they lie while the copies are few."""
    kept = windows.where(F.col("reason") == KEPT)
    return kept.join(copies, "row", "left_anti").drop("row", "reason")


def build_chunks(docs: DataFrame, rare_entities: bool = True) -> DataFrame:
    """Documents to stored chunks in one go, for a batch: cut, filter, key, one row per chunk id.

    ``row_number = 1`` is pushed below the shuffle as a group limit.
    """
    kept = judged_windows(docs, rare_entities).where(F.col("reason") == KEPT)
    order = Window.partitionBy("chunk_uuid").orderBy("doc_id", "chunk_index")
    return kept.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "row", "reason")


def split_sections(docs: DataFrame, body: str, carry: list[str]) -> DataFrame:
    """Cut text at ``== Heading ==`` lines; text before the first one is the overview.

    Headings are marked with two control characters, so one split yields
    (heading, body) pieces without looking backwards.
    """
    start, end = "\x01", "\x02"
    heading = "(?m)^(={2,6})[ \\t]*([^=\\n](?:[^\\n]*?[^=\\s])?)[ \\t]*\\1[ \\t]*$"
    marked = F.regexp_replace(F.col(body), heading, f"{start}$2{end}")
    pieces = docs.select(*carry, F.posexplode(F.split(marked, start)).alias("idx", "_piece"))
    named = F.when(F.col("idx") == 0, F.lit("Overview")).otherwise(
        text.strip(F.element_at(F.split("_piece", end), 1)))
    rest = F.when(F.col("idx") == 0, F.col("_piece")).otherwise(F.element_at(F.split("_piece", end), 2))
    out = pieces.select(*carry, "idx", named.alias("title"), text.strip(rest).alias("body"))
    prose = ~F.lower("title").isin(C.BOILERPLATE) | (F.col("idx") == 0)
    return out.where((F.col("body") != "") & prose)
