"""Evidence signals, entity grounding and answer-ability verdicts, set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text

STATUS = ["quality_empty", "quality_weak", "quality_ok"]


# ---------------------------------------------------------------- signals

def source_text(title: Column, url: Column) -> Column:
    return F.concat_ws(" ", title, url)


def noise_reason(title: Column, url: Column, content: Column) -> Column:
    """Why a row is noise, NULL when it is not: its source first, then word density."""
    dense = F.size(text.noise_hits(F.coalesce(content, F.lit("")))) >= C.NOISE_DENSITY
    return F.when(F.size(text.noise_hits(source_text(title, url))) > 0, "source_match").when(dense, "content_density")


def annotate(rows: DataFrame) -> DataFrame:
    """Noise and time signals as columns; noise rows stay in the table."""
    noise = noise_reason(F.col("source_title"), F.col("source_url"), F.col("content")).isNotNull()
    both = F.concat_ws(" ", "source_title", "content")
    return rows.withColumn("is_noise", noise).withColumn("temporal", text.is_temporal(both))


def refine_web(rows: DataFrame) -> DataFrame:
    """Web rows worth keeping, the first few per query in result order."""
    noise = noise_reason(F.col("source_title"), F.col("source_url"), F.col("content")).isNotNull()
    ugc = F.lower(F.coalesce("source_url", F.lit(""))).rlike("|".join(d.replace(".", "[.]") for d in C.WEB_UGC_DOMAINS))
    good = rows.where((F.col("score") >= C.WEB_MIN_SCORE) & ~noise & ~(ugc & (F.col("score") <= C.WEB_UGC_SCORE)))
    order = Window.partitionBy("query_id").orderBy("pos")
    ranked = good.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= C.WEB_KEEP)
    return ranked.withColumn("pos", F.col("_rn")).drop("_rn")


# ---------------------------------------------------------------- intent

def intent_signals(message: Column) -> Column:
    """Sorted array of the intent families found in a message."""
    line = F.lower(text.squeeze(message))
    found = [F.when(line.rlike(text.whole_word("|".join(p))), F.lit(name)) for name, p in sorted(C.INTENT_PATTERNS.items())]
    return F.array_compact(F.array(*found))


def primary_task(signals: Column) -> Column:
    task = F.lit("open")
    for name in ("factual", "listicle", "comparison"):
        task = F.when(F.array_contains(signals, name), name).otherwise(task)
    return task


def routing_line(message: Column) -> Column:
    """A message as the patterns read it; a column of its own, so that several of them share it."""
    return F.lower(text.squeeze(message))


def task_of_line(line: Column) -> Column:
    """primary_task of a routing_line, without a list of signals: only the patterns that decide are tried."""
    task = F
    for name in ("comparison", "listicle", "factual"):
        task = task.when(line.rlike(text.whole_word("|".join(C.INTENT_PATTERNS[name]))), name)
    return task.otherwise("open")


def strategy(task: Column, signals: Column) -> Column:
    """Struct of retrieval settings for a routed message."""
    temporal = F.array_contains(signals, "temporal")
    out = None
    for name, widened, limit, window, decompose, web in C.STRATEGIES:
        hit = task == name
        if name == "factual":
            hit = hit & ((F.size(signals) > 1) == F.lit(widened))
        row = F.struct(
            F.lit(limit).alias("limit"), F.lit(window).alias("window"), F.lit(decompose).alias("decompose"),
            (F.lit(True) if web == "always" else temporal).alias("web"),
        )
        out = F.when(hit, row) if out is None else out.when(hit, row)
    return out


def decompose(message: Column) -> Column:
    """Split at the last separator word; one part when a side would be empty."""
    cut = f"(?is)^(.*{text.NOT_WORD}|)(vs|versus|and|compare)({text.NOT_WORD}.*|)$"
    left = text.strip(F.regexp_extract(message, cut, 1))
    right = text.strip(F.regexp_extract(message, cut, 3))
    return F.when((left != "") & (right != ""), F.array(left, right)).otherwise(F.array(message))


# ---------------------------------------------------------------- spans and grounding

def spans(message: Column, sentence_initial: bool) -> Column:
    """Maximal runs of capitalised tokens, as an array of lower-cased phrases.

    Every token is marked: ``^`` opens or continues a run, ``~`` only continues
    one (numbers, Roman numerals, connectors before a capital), ``|`` breaks.
    A run is then one regular expression over the marked line.
    """
    stop = F.array(*[F.lit(w) for w in C.SPAN_STOPWORDS])
    roman = F.array(*[F.lit(w) for w in C.ROMAN_NUMERALS])
    connectors = F.array(*[F.lit(w) for w in C.CONNECTORS])
    toks = text.name_tokens(F.coalesce(message, F.lit("")))

    def capital(t: Column) -> Column:
        return t.rlike("^[A-Z]") & ~F.array_contains(stop, F.lower(t))

    def mark(pair: Column, i: Column) -> Column:
        t, following = pair["t"], pair["n"]
        low = F.lower(t)
        number = t.rlike("^[0-9]+$") | ((F.upper(t) == t) & F.array_contains(roman, low))
        bridge = F.array_contains(connectors, low) & F.coalesce(capital(following), F.lit(False))
        marked = F.when(capital(t), F.concat(F.lit("^"), low)).when(number | bridge, F.concat(F.lit("~"), low)).otherwise("|")
        return marked if sentence_initial else F.when(i == 0, "|").otherwise(marked)

    pairs = F.arrays_zip(toks.alias("t"), F.slice(toks, 2, 1_000_000_000).alias("n"))
    line = F.array_join(F.transform(pairs, mark), " ")
    runs = F.regexp_extract_all(line, F.lit(r"(\^[^ ]+(?: [\^~][^ ]+)*)"), 1)
    return F.transform(runs, lambda r: F.regexp_replace(r, r"[\^~]", ""))


def span_rows(queries: DataFrame, message: str, sentence_initial: bool) -> DataFrame:
    found = spans(F.col(message), sentence_initial)
    return queries.select("query_id", F.posexplode(found).alias("span_no", "span"))


def match_spans(queries: DataFrame, message: str) -> DataFrame:
    """Spans of both readings, each once per query."""
    both = F.array_union(spans(F.col(message), False), spans(F.col(message), True))
    return queries.select("query_id", F.explode(both).alias("span"))


def title_phrase(title: Column) -> Column:
    return F.lower(F.array_join(text.name_tokens(title), " "))


def exact_hits(span_table: DataFrame, titles: DataFrame, title: str) -> DataFrame:
    known = titles.select(title_phrase(F.col(title)).alias("span")).distinct()
    return span_table.join(known, "span", "left_semi").select("query_id", "span")


def prefix_hits(span_table: DataFrame, evidence: DataFrame) -> DataFrame:
    """Spans that open an evidence title once its leading stop words are gone.

    Every title is expanded to its own prefixes, so the prefix test is a hash
    join.  Repeated (query, title) rows are merged before anything is expanded.
    """
    local = evidence.where(F.coalesce("source_type", F.lit("local")) != "web").select("query_id", "source_title").distinct()
    leading = f"^(?:(?:{'|'.join(C.SPAN_STOPWORDS)})(?: |$))+"
    toks = F.split(F.regexp_replace(title_phrase(F.col("source_title")), leading, ""), " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("toks")), lambda n: F.array_join(F.slice("toks", 1, n), " "))
    opened = local.select("query_id", "source_title", toks.alias("toks")).select(
        "query_id", "source_title", F.explode(prefixes).alias("span"))
    return span_table.join(opened, ["query_id", "span"]).select("query_id", "span", F.col("source_title").alias("title"))


def grounding(queries: DataFrame, message: str, titles: DataFrame, title: str, evidence: DataFrame) -> DataFrame:
    """(query_id, grounded): NULL without a span or without any known title, true if one is known, else false."""
    found = match_spans(queries, message)
    hits = exact_hits(found, titles, title).select("query_id").union(prefix_hits(found, evidence).select("query_id")).distinct()
    any_title = titles.agg(F.count(title) > 0).scalar()
    named = (F.size(spans(F.col(message), False)) > 0) & any_title
    hit = hits.withColumn("hit", F.lit(True))
    return queries.select("query_id", named.alias("named")).join(hit, "query_id", "left").select(
        "query_id", F.when(F.col("named"), F.coalesce("hit", F.lit(False))).alias("grounded"))


# ---------------------------------------------------------------- verdicts

def relevance_aggregate(rows: DataFrame) -> DataFrame:
    """Per query, over rows that are not noise; n_rows counts all."""
    good = ~F.col("is_noise")
    corpus = good & (F.coalesce("source_type", F.lit("local")) != "web")
    web = good & (F.col("source_type") == "web")
    return rows.groupBy("query_id").agg(
        F.count("*").alias("n_rows"),
        F.max(F.when(good, F.col("rerank_score"))).alias("max_rel"),
        F.max(F.when(corpus, F.col("rerank_score"))).alias("corpus_max"),
        F.max(F.when(web, F.col("rerank_score"))).alias("web_max"),
        F.round(F.avg(F.when(good, F.coalesce("score", F.lit(0.0)))), 6).alias("avg_score"),
        F.coalesce(F.max(F.when(good, F.col("temporal"))), F.lit(False)).alias("temporal"),
        F.count_if(good).alias("evidence_count"),
    )


def _rank(value: Column) -> Column:
    """Status code of a relevance value against the floors: 0 empty, 1 weak, 2 ok."""
    return F.when(value < F.col("refuse"), 0).when(value < F.col("weak"), 1).otherwise(2)


def _status(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUS]), code + 1)


def with_floors(queries: DataFrame, providers: list[str]) -> DataFrame:
    """One row per query and scorer, with that scorer's floors (NULL = uncalibrated)."""
    rows = []
    for p in providers:
        refuse, weak = C.FLOORS[p] or (None, None)
        rows.append(F.struct(F.lit(p).alias("provider"), F.lit(refuse).cast("double").alias("refuse"),
                             F.lit(weak).cast("double").alias("weak")))
    return queries.select("query_id", F.explode(F.array(*rows)).alias("f")).select("query_id", "f.*")


def verdicts(queries: DataFrame, aggregate: DataFrame, grounded: DataFrame, providers: list[str]) -> DataFrame:
    """The ordered ladder: no rows, only noise, unknown entity, no floors, floors."""
    joined = with_floors(queries, providers).join(aggregate, "query_id", "left").join(grounded, "query_id", "left")
    observed = _rank(F.col("max_rel"))
    ceiling = F.when(F.col("corpus_max").isNull(), 0).otherwise(_rank(F.col("corpus_max")))
    final = F.least(observed, ceiling)
    none, noise = F.col("n_rows").isNull(), F.col("evidence_count") == 0
    absent = ~F.coalesce("grounded", F.lit(True))
    skipped = F.col("max_rel").isNull() | F.col("refuse").isNull()
    code = F.when(none, 0).when(noise, 1).when(absent, 0).when(skipped, 2).otherwise(final)
    reason = (
        F.when(none, "no_evidence").when(noise, "only_noise").when(absent, "entity_absent")
        .when(skipped, "floor_skipped").when(final < observed, "web_clamped")
        .otherwise(F.element_at(F.array(F.lit("below_refuse_floor"), F.lit("below_weak_floor"), F.lit("sufficient")), final + 1))
    )
    confidence = F.when(none | noise | absent, 0.0).when(skipped, F.col("avg_score")).otherwise(F.col("max_rel"))
    reached = ~(none | noise | absent | skipped)
    return joined.select(
        "query_id", "provider", _status(code).alias("status"), reason.alias("reason"), confidence.alias("confidence"),
        F.coalesce("temporal", F.lit(False)).alias("temporal"), "grounded",
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        F.when(reached, _status(observed)).alias("observed"), F.when(reached, _status(ceiling)).alias("ceiling"),
        F.coalesce(reached & (final < observed), F.lit(False)).alias("clamped"),
    )


def web_merge(before: DataFrame, settings: DataFrame, web: DataFrame, after: DataFrame) -> DataFrame:
    """Which queries ask the web, what they get, and both verdicts.

    before, after: (query_id, status, temporal); settings: (query_id, web); web: refined rows.
    """
    contributed = web.select("query_id").distinct().withColumn("has_web", F.lit(True))
    rows = (
        before.join(settings, "query_id").join(contributed, "query_id", "left")
        .join(after.select("query_id", F.col("status").alias("merged")), "query_id", "left")
    )
    asks = F.col("status").isin(STATUS[0], STATUS[1]) | (F.col("web") & F.col("temporal"))
    merged = asks & F.coalesce("has_web", F.lit(False))
    state = F.when(merged, "LOCAL_PLUS_WEB").when(asks, "LOCAL_WEB_ATTEMPTED").otherwise("LOCAL_ONLY")
    return rows.select(
        "query_id", state.alias("merge_state"), F.col("status").alias("status_before"),
        F.when(merged, F.col("merged")).otherwise(F.col("status")).alias("status_after"),
    )


def entity_balance(rows: DataFrame) -> DataFrame:
    """Entities per query and whether one of them dominates."""
    entity = F.coalesce(F.nullif(F.col("retrieval_context"), F.lit("")), F.nullif(F.col("source_title"), F.lit("")))
    per = rows.select("query_id", entity.alias("entity")).where("entity IS NOT NULL").groupBy("query_id", "entity").count()
    out = per.groupBy("query_id").agg(
        F.count("*").alias("entities"), F.max("count").alias("max_n"), F.min("count").alias("min_n"))
    return out.withColumn("unbalanced", (F.col("entities") < 2) | (F.col("max_n") > F.col("min_n") * C.IMBALANCE))


def capability(asked: DataFrame, verdict: DataFrame, balance: DataFrame) -> DataFrame:
    """(query_id, asked, capability, reason); asked: (query_id, asked, signals)."""
    rows = asked.join(verdict, "query_id").join(balance, "query_id", "left")
    compares = F.array_contains("signals", "comparison")
    dated = F.array_contains("signals", "temporal")
    empty = (F.col("status") == STATUS[0]) | (F.col("evidence_count") == 0) & (F.col("reason") == "no_evidence")
    narrow = compares & (F.coalesce("entities", F.lit(0)) < 2)
    lopsided = compares & F.coalesce("unbalanced", F.lit(True))
    stale = dated & ~F.col("temporal")
    weak = F.col("status") == STATUS[1]
    grade = F.when(empty | narrow, "insufficient").when(weak | lopsided | stale, "partial").otherwise("full")
    why = (
        F.when(F.col("evidence_count") == 0, "no_evidence").when(empty, F.concat(F.lit("quality_empty:"), "reason")).when(narrow, "comparison_entity_coverage")
        .when(stale, "no_temporal_evidence").when(lopsided, "unbalanced_entities").when(weak, "weak_evidence").otherwise("sufficient")
    )
    return rows.select("query_id", "asked", grade.alias("capability"), why.alias("reason"))
