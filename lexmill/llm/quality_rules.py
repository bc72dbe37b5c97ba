"""Quality rules whose thresholds adapt to each language and source.

Every signal of every document that passes the base rules goes into a log-linear histogram, a
quantile sketch of bounded size that merges by adding counts: exact up to 64, then 32 buckets
for each power of two.  A fence lies TIMES as far from the median as the HIGH quantile of the
sketch (for word length also on the lower side), so a group without spread has its fence at the
median itself: no cutoff is the same everywhere.  Quantiles are taken at the outer end of their
bucket.  Because one event in a short text is a large share of it, a text passes a share's fence
with one event above it (``EVENT``).  Words of repeated lines, at the mean length of the text's
lines, are left to the rule on lines.  Groups with too few documents use the merged sketch of
their language, then the one of the whole corpus.  The fences are joined back to the documents.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from .common import materialize
from .words import split_words

SYMBOLS = "#*$%&|<>"
WHITE = "".join(chr(c) for c in (0x20, *range(0x09, 0x0E)))

#: Shares are per 10,000 words (symbols, repeats) or lines, word length is per 100 words.
SIGNALS = ("symbols", "repeats", "dup_lines", "word_length")
TWO_SIDED = {"word_length"}
#: The least a count can rise by: a symbol, two equal windows of three words, a line.
EVENT = {"symbols": 1, "repeats": 6, "dup_lines": 1}
#: Tenths of the documents below the high quantile; the low one mirrors it.
HIGH = 9
TIMES = 3
MIN_DOCS = 200


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text."""
    count = F.greatest(F.size(words) - 2, F.lit(0))
    three = F.arrays_zip(
        F.slice(words, 1, count).alias("a"), F.slice(words, 2, count).alias("b"), F.slice(words, 3, count).alias("c")
    )

    def hashed(x: Column) -> Column:
        return F.xxhash64(x["a"], x["b"], x["c"])

    def covered(windows: Column) -> Column:
        # equal windows are neighbours after sorting; the hash goes first to make that cheap
        rows = F.sort_array(F.transform(windows, lambda x, i: F.struct(hashed(x).alias("h"), x.alias("x"), i.alias("i"))))

        def neighbours(s: Column) -> Column:
            pairs = F.zip_with(
                F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))),
                F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))),
                lambda p, q: F.when(
                    (p["h"] == q["h"]) & (p["x"] == q["x"]),
                    F.array(*[r["i"] + k for r in (p, q) for k in range(3)]),
                ),
            )
            return F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))

        return _let(rows, neighbours)

    return _let(
        three,
        lambda w: F.when(F.size(F.array_distinct(F.transform(w, hashed))) == F.size(w), F.lit(0)).otherwise(covered(w)),
    )


def signals(docs: DataFrame) -> DataFrame:
    """Counts of the base rules for every row; NULL texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, WHITE, "")) > 0)
    known = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("lang_key"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"),
        split_words(text).alias("words"),
        F.length(F.translate(text, WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
    )
    counted = known.select(
        "doc_id", "lang_key", "source_key", F.size("words").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).cast("bigint").alias("n_dup_lines"),
        F.col("lines.n").cast("bigint").alias("n_lines"),
        _repeat_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _measures() -> dict[str, Column]:
    return {
        "symbols": F.expr("10000 * n_symbols div greatest(n_words, 1)"),
        "repeats": F.expr("10000 * n_repeat_words div greatest(n_words, 1)"),
        "dup_lines": F.expr("10000 * n_dup_lines div greatest(n_lines, 1)"),
        "word_length": F.expr("100 * word_chars div greatest(n_words, 1)"),
    }


def bucket(value: Column) -> Column:
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 32 + F.floor(value / F.pow(F.lit(2.0), shift))).cast("bigint")


def bucket_start(number: Column) -> Column:
    shift = F.greatest(F.floor(number / 32) - 1, F.lit(0))
    return ((number - 32 * shift) * F.pow(F.lit(2.0), shift)).cast("bigint")


def sketches(counted: DataFrame) -> DataFrame:
    """One row per level, group, signal and bucket: 0 is (language, source), 1 language, 2 all."""
    values = F.array(*[F.struct(F.lit(k).alias("signal"), bucket(m).alias("bucket")) for k, m in _measures().items()])
    fine = (
        counted.where(~F.col("base_failed"))
        .select("lang_key", "source_key", F.explode(values).alias("v"))
        .groupBy("lang_key", "source_key", "v.signal", "v.bucket")
        .agg(F.count("*").alias("n"))
    )
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang_key").alias("lk"), F.col("source_key").alias("sk")),
        F.struct(F.lit(1).alias("level"), F.col("lang_key").alias("lk"), F.lit("").alias("sk")),
        F.struct(F.lit(2).alias("level"), F.lit("").alias("lk"), F.lit("").alias("sk")),
    )
    return (
        fine.select(F.explode(levels).alias("g"), "signal", "bucket", "n")
        .groupBy("g.level", F.col("g.lk").alias("lang_key"), F.col("g.sk").alias("source_key"), "signal", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def fences(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Thresholds for every (language, source) that has documents past the base rules."""
    group = Window.partitionBy("level", "lang_key", "source_key", "signal")  # at most a sketch's buckets
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.select(
        "*", F.sum("n").over(upto).alias("cum"), F.sum("n").over(group.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )

    def quantile(tenths: int) -> Column:
        return F.min(F.when(10 * F.col("cum") >= tenths * F.col("total"), F.col("bucket")))

    quantiles = ranked.groupBy("level", "lang_key", "source_key", "signal").agg(
        bucket_start(quantile(10 - HIGH)).alias("low"), bucket_start(quantile(5)).alias("middle"),
        (bucket_start(quantile(HIGH) + 1) - 1).alias("high"), F.max("total").alias("docs"),
    )
    columns = []
    for name in SIGNALS:
        at = F.col("signal") == name
        columns.append(F.max(F.when(at, F.expr(f"middle + {TIMES} * (high - middle)"))).alias(f"most_{name}"))
        if name in TWO_SIDED:
            columns.append(F.max(F.when(at, F.expr(f"middle - {TIMES} * (middle - low)"))).alias(f"least_{name}"))
    wide = materialize(
        quantiles.groupBy("level", "lang_key", "source_key").agg(F.max("docs").alias("docs"), *columns), "fences"
    )
    names = [c for c in wide.columns if c.startswith(("most_", "least_"))]

    def level(n: int, keys: list[str]) -> DataFrame:
        return wide.where(F.col("level") == n).select(*keys, F.struct("docs", *names).alias(f"f{n}"))

    met = (
        level(0, ["lang_key", "source_key"])
        .join(level(1, ["lang_key"]), "lang_key")
        .withColumn("level", F.lit(2))
        .join(level(2, ["level"]), "level")
    )
    chosen = F.when(F.col("f0.docs") >= min_docs, F.col("f0")).when(F.col("f1.docs") >= min_docs, F.col("f1"))
    return met.select("lang_key", "source_key", chosen.otherwise(F.col("f2")).alias("f")).select(
        "lang_key", "source_key", *[f"f.{c}" for c in names]
    )


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, the base counts, base_failed and kept, one row per input row.

    NULL or blank texts have no words and fail the base rules; NULL languages and sources are
    groups of their own; repeated rows are judged alike; no rows give none; other columns are
    not read.
    """
    counted = materialize(signals(docs), "signals")
    limits = fences(sketches(counted), min_docs)
    judged = salted_join(counted, limits, ["lang_key", "source_key"], "doc_id", "left")
    measures, inside = _measures(), F.lit(True)
    counts = {"symbols": ("n_symbols", "n_words"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
    for name in SIGNALS:
        if name in TWO_SIDED:
            inside = inside & measures[name].between(F.col(f"least_{name}"), F.col(f"most_{name}"))
        else:
            n, of = counts[name]
            spare = EVENT[name]
            if name == "repeats":
                spare = f"{spare} - n_dup_lines * (2 * n_words div greatest(n_lines, 1))"
            inside = inside & F.expr(f"10000 * ({n} - {spare}) <= most_{name} * {of}")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"),
    )
