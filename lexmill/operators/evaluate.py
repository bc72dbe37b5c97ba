"""Scores, confusion counts, latency and cost reports over run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text
from ..functions.joins import salted_join
from ..functions.numbers import rounded
from ..functions.ranking import ordered_stats, value_counts


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """Rounded quotient, 0 on an empty denominator."""
    return rounded(F.when(b > 0, a / b).otherwise(0.0), digits)


# ---------------------------------------------------------------- refusals

def confusion(runs: DataFrame) -> DataFrame:
    """One row of refusal metrics; runs: (should_refuse, refused, errored)."""
    ok, want, got = ~F.col("errored"), F.col("should_refuse"), F.col("refused")
    c = runs.agg(
        F.count_if(ok & want & got).alias("tp"), F.count_if(ok & ~want & got).alias("fp"),
        F.count_if(ok & want & ~got).alias("fn"), F.count_if(ok & ~want & ~got).alias("tn"),
        F.count_if(F.col("errored")).alias("errored"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return c.select(
        "tp", "fp", "fn", "tn", rounded(p, 4).alias("precision"), rounded(r, 4).alias("recall"), rounded(f1, 4).alias("f1"),
        ratio(fn, tp + fn).alias("false_answer_rate"), ratio(fp, fp + tn).alias("over_refusal_rate"), "errored",
    )


def confusion_by(runs: DataFrame, state: str) -> DataFrame:
    scored = runs.where(~F.col("errored"))
    return scored.groupBy(F.coalesce(state, F.lit("unknown")).alias(state)).agg(
        F.count("*").alias("total"), F.count_if("refused").alias("refused"), F.count_if("should_refuse").alias("should_refuse"))


def capability_shares(runs: DataFrame, capability: str) -> DataFrame:
    c = runs.agg(F.count("*").alias("n"), *[F.count_if(F.col(capability) == k).alias(k) for k in ("full", "partial", "insufficient")])
    n = F.col("n")
    return c.select(
        *[ratio(F.col(k), n).alias(k) for k in ("full", "partial", "insufficient")],
        ratio(F.col("full") + F.col("partial"), n).alias("honesty"), "n")


# ---------------------------------------------------------------- thresholds

def gap_candidates(scores: DataFrame, score: str) -> DataFrame:
    """Midpoints between neighbouring distinct scores and the share below each."""
    steps = ordered_stats(value_counts(scores, score), score, ["n"]).where(F.col(f"next_{score}").isNotNull())
    low, high = F.col(score), F.col(f"next_{score}")
    return steps.select(
        F.round((low + high) / 2, 6).alias("midpoint"), F.round(high - low, 6).alias("gap"),
        rounded(100.0 * F.col("cum_n") / F.col("tot_n"), 2).alias("weak_pct"))


def best_threshold(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Best F1 over every observed score and one above the largest.

    Everything below a threshold is predicted positive, so one pass of running
    sums gives all confusion counts; ties go to the smallest threshold.  Without scores there is no row.
    """
    per = scores.groupBy(score).agg(F.count_if(label).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    stats = ordered_stats(per, score, ["pos", "neg"])
    below = stats.select(
        F.col(score).alias("threshold"), (F.col("cum_pos") - F.col("pos")).alias("tp"), (F.col("cum_neg") - F.col("neg")).alias("fp"), "tot_pos", "tot_neg")
    above = stats.agg((F.max(score) + 1e-6).alias("threshold"), F.max("tot_pos").alias("tp"), F.max("tot_neg").alias("fp"),
                      F.max("tot_pos").alias("tot_pos"), F.max("tot_neg").alias("tot_neg")).where("threshold IS NOT NULL")
    c = below.unionByName(above).select("threshold", "tp", "fp", (F.col("tot_pos") - F.col("tp")).alias("fn"), (F.col("tot_neg") - F.col("fp")).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    graded = c.select("*", p.alias("precision"), r.alias("recall"), f1.alias("f1"))
    best = graded.agg(F.max_by(F.struct(*graded.columns), F.struct(F.col("f1"), -F.col("threshold"))).alias("b")).where("b IS NOT NULL").select("b.*")
    return best.select(rounded(F.col("threshold"), 6).alias("threshold"), *[rounded(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")], "tp", "fp", "fn", "tn")


# ---------------------------------------------------------------- titles and entities

def normalized(c: Column) -> Column:
    return F.lower(text.strip(text.fold_apostrophes(c)))


def entity(retrieval_context: Column, source_title: Column) -> Column:
    """The name a row stands for; the fallback marker is not a name."""
    context = F.when(~text.blank(retrieval_context) & (retrieval_context != "fallback"), retrieval_context)
    title = F.when(~text.blank(source_title), source_title)
    return normalized(F.coalesce(context, title))


def similar(a: Column, b: Column) -> Column:
    return (a == b) | a.contains(b) | b.contains(a)


def entity_matches(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, want, found) for every expected name; lists are bounded per query."""
    have = retrieved.select("query_id", entity(F.col("retrieval_context"), F.col("source_title")).alias("have")).where("have IS NOT NULL")
    sets = have.groupBy("query_id").agg(F.collect_set("have").alias("haves"))
    want = expected.select("query_id", normalized(F.col("expected")).alias("want"))
    found = F.coalesce(F.exists("haves", lambda h: similar(h, F.col("want"))), F.lit(False))
    return want.join(sets, "query_id", "left").select("query_id", "want", found.alias("found"))


def precision_at_k(retrieved: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Title hits in the first k rows, divided by k and not by the rows returned; every expected query has a row."""
    top = retrieved.where(F.col("pos") <= k).select("query_id", "pos", normalized(F.col("source_title")).alias("want"))
    wanted = expected.select("query_id", normalized(F.col("expected")).alias("want"), F.lit(1).alias("hit")).distinct()
    hits = top.join(wanted, ["query_id", "want"]).select("query_id", "hit")
    rows = expected.select("query_id").distinct().join(hits, "query_id", "left")
    return rows.groupBy("query_id").agg(F.count("hit").alias("hits")).select("query_id", "hits", F.round(F.col("hits") / k, 4).alias("precision"))


# ---------------------------------------------------------------- answers

def citations(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(C.CITATION), 1)


def with_titles(answers: DataFrame, context: DataFrame, group: str, spread_by: str) -> DataFrame:
    """Attach the normalised context titles of each answer's group (a short list)."""
    lists = context.groupBy(group).agg(F.collect_set(F.lower(text.strip(F.col("title")))).alias("titles"))
    out = salted_join(answers, lists, [group], spread_by, "left")
    return out.withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def matches_title(citation: Column) -> Column:
    return F.exists("titles", lambda t: similar(t, F.lower(text.strip(citation))))


def answer_issues(answer: Column, partial: Column) -> Column:
    """Sorted issue codes of an answer, given its context titles in ``titles``."""
    cited = citations(answer)
    empty = text.blank(answer)

    def odd(mark: str) -> Column:
        return F.pmod(text.occurrences(answer, mark).cast("int"), F.lit(2)) == 1

    tests = {
        "empty": empty, "unclosed_bold": odd("**"), "unclosed_underscore": odd("_"), "unclosed_code": odd("`"),
        "missing_section": partial & ~answer.contains(C.PARTIAL_SECTION),
        "unmatched_citation": F.exists(cited, lambda c: ~matches_title(c)),
        "no_citation": ~empty & (F.size(cited) == 0),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))


def is_refusal(answer: Column) -> Column:
    return ~text.blank(answer) & (F.length(answer) <= C.REFUSAL_CHARS) & ~answer.rlike(C.CITATION)


def fidelity(answer: Column) -> Column:
    """Struct (sentences, grounded): sentences whose first citation is a context title."""
    sentences = F.filter(F.split(answer, "[.!?]+"), lambda s: text.strip(s) != "")

    titles = F.transform("titles", text.fold_apostrophes)

    def grounded(s: Column) -> Column:
        return F.array_contains(titles, text.fold_apostrophes(F.lower(text.strip(F.regexp_extract(s, C.CITATION, 1)))))

    return F.struct(F.size(sentences).alias("sentences"), F.size(F.filter(sentences, grounded)).alias("grounded"))


# ---------------------------------------------------------------- history

HISTORY_BLOCK = 4096


def conversation_history(turns: DataFrame, n: int = C.HISTORY_TURNS, cap: int = C.HISTORY_CHARS) -> DataFrame:
    """The last n turns before each turn, as ``role: text`` lines.

    Turns are cut into blocks, so one endless conversation is many window
    groups.  The last n turns of the blocks before are carried into the first
    turns of a block: n rows per block, found by a group limit.
    """
    line = F.concat(F.coalesce("role", F.lit("user")), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, cap))
    rows = turns.select("conv_id", "turn", line.alias("line"), F.floor(F.col("turn") / HISTORY_BLOCK).alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    own = rows.withColumn("own", F.collect_list("line").over(inside.rowsBetween(-n, -1)))
    last = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.desc("turn")))).where(F.col("_rn") <= n)
    tails = last.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("tail"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(-n, -1)
    carry = tails.select("conv_id", "block", F.flatten(F.collect_list(F.col("tail.line")).over(before)).alias("carry"))
    both = own.join(carry, ["conv_id", "block"])
    lines = F.concat("carry", "own")
    kept = F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n)
    return both.select("conv_id", "turn", F.when(F.size(lines) > 0, F.array_join(kept, "\n")).otherwise("(none)").alias("history"))


# ---------------------------------------------------------------- costs

def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per row; a model without a price costs nothing."""
    rows = usage.join(prices, "model", "left")
    cost = F.col("prompt_tokens") / 1_000_000 * F.col("input_rate") + F.col("completion_tokens") / 1_000_000 * F.col("output_rate")
    return rows.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0)))
