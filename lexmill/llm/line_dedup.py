"""Lines that several documents share: kept in the first document, dropped from the others.

Texts are exploded into normalised lines, every long enough line becomes a hash of 128 bits, the
distinct documents of each hash are counted, and the lines whose count reaches the threshold go from all
documents but the one with the smallest doc_id.  What stays is put together again by position.
DataFrame functions only; a line found in a third of all documents is merged before each shuffle
and met through salted parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from .common import ROW_KEY, ids_are_keys, key_to_id, materialize, with_row_key

WHITE = "".join(chr(c) for c in (0x20, *range(0x09, 0x0E)))
UPPER, LOWER = (bytes(range(a, a + 26)).decode() for a in (0x41, 0x61))
MIN_CHARS, MIN_DOCS = 10, 2
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """Lines of a text; a NULL or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(WHITE))
    # lower() knows more letters than A-Z; on ASCII it is the same and much faster
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(keyed: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Row key, position from 0 and hash of every line whose key has ``min_chars`` code points or more."""
    exploded = keyed.select(*ROW_KEY, F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "line"))
    # the leading constant starts the second hash from another seed
    return exploded.where(F.length("line") >= min_chars).select(
        *ROW_KEY, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2")
    )


def document(plain: bool) -> Column:
    """Which document a row belongs to: its doc_id; rows without one are told apart by text and come last."""
    no_id = F.col("_tag").bitwiseAND(F.lit(1)) == 1
    if plain:
        return F.col("_rid").alias("document")
    return F.struct(no_id.alias("no_id"), "_rid", F.when(no_id, F.col("_tag")).otherwise(0).alias("t")).alias("document")


def shared_lines(lines: DataFrame, plain: bool, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes that ``min_docs`` documents or more hold, with the first document."""
    held = lines.select(*HASH, document(plain))
    # Spark deals distinct (hash, document) rows first, so a common line is not counted in one task
    counted = held.groupBy(*HASH).agg(F.count_distinct("document").alias("docs"), F.min("document").alias("first"))
    return counted.where(F.col("docs") >= min_docs)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text, one row per input row.

    Rows with one doc_id are one document, and so are rows without doc_id that have one text; these
    come after all ids.  NULL and empty texts have one empty line; a text that loses every line is
    empty; repeats inside the document that keeps a line stay; repeated rows get the same result;
    no rows give none; other columns are not read.
    """
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    plain = ids_are_keys(picked)
    keyed = with_row_key(picked, plain).select(*ROW_KEY, "text")
    lines = materialize(line_hashes(keyed, min_chars), "lines")
    shared = materialize(shared_lines(lines, plain, min_docs), "shared")
    met = salted_join(lines, shared, HASH, "_rid").where(document(plain) != F.col("first"))
    # a set: repeated rows name the same positions
    gone = met.groupBy(*ROW_KEY).agg(F.collect_set("pos").alias("gone"))
    joined = keyed.join(gone, ROW_KEY, "left").select(*ROW_KEY, lines_of(F.col("text")).alias("lines"), "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(stay, lambda i: F.element_at("lines", i + 1))
    )
    return joined.select(
        key_to_id(), F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.concat_ws("\n", kept).alias("kept_text"),
    )
