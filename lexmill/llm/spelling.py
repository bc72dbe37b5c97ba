"""Spelling variants: words one edit apart, found through asymmetric q-chunks.

A word of length L contributes two disjoint chunks of q = L // 2 code points, its halves.  The word it is
compared with contributes positional grams of that q.  One inserted, deleted or replaced code point
lies in one half only, so the other half is among the partner's grams: the first half at its place,
the second half shifted by the difference in length, which is at most one.  The half with the edit
is cut once more by the same argument, so two words meet on three quarters of their letters and
common beginnings or endings make no large groups.  Groups that are still large are cut on: inside
them words meet on the rest of the word with one code point deleted, which two words within one edit always
share and at most length times alphabet words can.  Every meeting is verified.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .line_dedup import LOWER, UPPER

RUN_GAP = r"[^A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, TYPO_EVERY, DOMINANCE = 7, 2, 31, 10
#: Pairs a group may compare by itself; larger groups are cut by deletions.
GROUP_PAIRS = 100_000
#: Counts fall at least tenfold along forms, so a chain of 64-bit counts has less than 2^5 links.
DOUBLINGS = 5


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """Distinct words with their number of occurrences n; a rule by document and run makes the spelling errors."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    # a shorter run cannot give a long enough word
    runs = F.filter(F.split(text, RUN_GAP), lambda run: F.length(run) >= min_chars)
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    wrong = F.concat(F.expr("substring(run, 1, cut)"), F.expr("substring(run, cut + 2)"))
    words = hashed.withColumn("cut", cut).select(F.when(F.col("h") % TYPO_EVERY == 0, wrong).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _part(at: Column, size: Column) -> Column:
    return F.substring("word", at + 1, size)


def _keys(length: Column, shift: Column) -> Column:
    """Keys under which a partner of ``length`` meets this word, which is ``shift`` longer.

    The partner's chunks are [0, q) and [q, 2q); r halves what is left after the first, s halves the
    first.  Parts behind the edit are looked up ``shift`` further on.
    """
    q = F.floor(length / 2).cast("int")
    r, s = F.floor((length - q) / 2).cast("int"), F.floor(q / 2).cast("int")
    zero = F.lit(0)
    parts = [
        ((zero, q), (q, r)), ((zero, q), (q + r + shift, r)),
        ((q + shift, q), (zero, s)), ((q + shift, q), (s + shift, q - s)),
    ]
    # places and chunk number are part of the key: only grams of the right place meet
    return F.array(*[
        F.concat_ws("\x01", F.lit(i), length, _part(*chunk), _part(*rest)) for i, (chunk, rest) in enumerate(parts)
    ])


def chunks(words: DataFrame) -> DataFrame:
    """The side that contributes its two chunks."""
    return words.select(F.explode(_keys(F.length("word"), F.lit(0))).alias("key"), "word", "n")


def grams(words: DataFrame) -> DataFrame:
    """The side that contributes grams, for partners one shorter, of equal length, and one longer."""
    shifted = words.select("word", "n", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("shift"))
    keys = _keys(F.length("word") - F.col("shift"), F.col("shift"))
    # two grams of one word may give one key
    return shifted.select(F.explode(F.array_distinct(keys)).alias("key"), "word", "n")


def _deletions(side: DataFrame) -> DataFrame:
    """Every row under its key joined with the word itself and each of its one-letter deletions."""
    places = F.sequence(F.lit(0), F.length("word"))
    return side.withColumn("at", F.explode(places)).select(
        "key", F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)")).alias("rest"), "word", "n"
    ).distinct()


def near_words(words: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """Rows (a, a_n, b, b_n), a < b: all pairs of distinct words exactly one edit apart."""
    left, right = chunks(words), grams(words)
    sizes = (
        left.groupBy("key").agg(F.count("*").alias("x")).join(right.groupBy("key").agg(F.count("*").alias("y")), "key")
        .where(F.col("x") * F.col("y") > group_pairs).select("key")
    )
    large = materialize(sizes, "large")

    def met(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        a, b = x.select(*keys, F.col("word").alias("a"), F.col("n").alias("a_n")), y.select(
            *keys, F.col("word").alias("b"), F.col("n").alias("b_n"))
        # each pair is found from both sides; one of them is enough
        pairs = a.join(b, keys).where(F.col("a") < F.col("b"))
        return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")

    if large.isEmpty():
        return met(left, right, ["key"]).distinct()
    small = met(left.join(large, "key", "left_anti"), right.join(large, "key", "left_anti"), ["key"])
    cut = [_deletions(side.join(large, "key", "left_semi")) for side in (left, right)]
    return small.union(met(*cut, ["key", "rest"])).distinct()


def spelling_variants(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, dominance: int = DOMINANCE,
    group_pairs: int = GROUP_PAIRS,
) -> DataFrame:
    """word, n, form, form_n, n_near and root, one row per word of ``min_count`` occurrences or more.

    form is the near word of most occurrences (ties: the smallest) if these are ``dominance`` times the
    word's; root is the end of the chain of forms.  NULL and empty texts hold no words, a NULL doc_id
    counts as an empty one, repeated rows count again, no rows give none; other columns are not read.
    """
    words = materialize(vocabulary(docs, min_chars, min_count), "vocabulary")
    pairs = materialize(near_words(words, group_pairs), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "a", "a_n")
    )
    # the structure orders by falling n, then by word: UTF-8 order is the order of code points
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    )
    most, wins = -F.col("best.m"), -F.col("best.m") >= dominance * F.col("n")
    judged = materialize(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(wins, F.col("best.near")).alias("form"), F.when(wins, most).alias("form_n"),
        ), "forms",
    )
    steps = judged.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        far = steps.select(F.col("word").alias("root"), F.col("root").alias("far"))
        steps = materialize(steps.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "roots")
    return judged.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
