"""Personal data, and terms that give it away.

Patterns find e-mail and IP addresses, card and phone numbers.  Each distinct value is a protected
entity.  Co-occurrence in the corpus estimates P(e | t), the share of the texts holding a term t in
which t stands close to an entity e: at 1 the pointwise mutual information of t and e is all of the
entity's own information, -log P(e), and below 1 it lacks -log P(e | t) of it.  Both thresholds bound
that lack (0.15 and 1 bit), not its ratio to the whole, so they mean the same for frequent and rare
entities.  Terms above the upper threshold give the entity away wherever they stand and are removed
from all texts.  Terms above the lower one are generalised to their shape throughout the texts that
hold the entity.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from .common import ROW_KEY, key_to_id, materialize, with_row_key

KINDS = ("email", "ip", "card", "phone")
GENERAL, REMOVED = "generalise", "remove"

#: Words on either side of a value that count as close to it.
REACH = 8
#: Different surroundings in which term and entity must meet; copies of one text count once.
MIN_CONTEXTS = 3
GENERALISE_AT, REMOVE_AT = 0.5, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# digits before a match could only belong to it: the match would have started there
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Same spans as searching the whole pattern, in linear time: every match holds one @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, normalised value), ordered by start, then kind."""
    if not text:
        return []
    out = [(s, 0, e, text[s:e].lower()) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(_small(p) for p in m.groups()):
            out.append((m.start(), 1, m.end(), m.group()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _digits(m.group())
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def term(word: str) -> str | None:
    """A word as a term: lower case, without punctuation around it; short ones are none."""
    bare = word.strip(_EDGES).lower()
    return bare if len(bare) >= 3 and any(c.isalnum() for c in bare) else None


def _hash(*parts: object) -> int:
    value = xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _merged(spans: list[tuple[int, int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans."""
    starts, ends = [], []
    for s, _, e, _ in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _outside(starts: list[int], ends: list[int], low: int, high: int) -> bool:
    i = bisect_left(starts, high) - 1
    return i < 0 or ends[i] <= low


def near_terms(text: str, spans: list[tuple[int, int, int, str]], reach: int) -> list[dict]:
    """Terms close to each value: entity, term, and a hash of the surroundings.

    Only the first meeting of an entity and a term in the text is listed.  Words that are personal
    data themselves are no terms.
    """
    words = [(m.start(), m.end(), term(m.group())) for m in _WORD.finditer(text)]
    begins, finishes = [w[0] for w in words], [w[1] for w in words]
    starts, ends = _merged(spans)

    def free(w: tuple) -> bool:
        return w[2] is not None and _outside(starts, ends, w[0], w[1])

    out, seen = [], set()
    for start, kind, end, value in spans:
        before, after = bisect_right(finishes, start), bisect_left(begins, end)
        close = [w for w in words[max(0, before - reach) : before] + words[after : after + reach] if free(w)]
        entity, around = _hash(kind, value), _hash(*(w[2] for w in close))
        for _, _, t in close:
            h = _hash(t)
            if (entity, h) not in seen:
                out.append({"entity": entity, "term": h, "around": around})
                seen.add((entity, h))
    return out


FOUND = (
    "_rid bigint, _tag int, base array<struct<low:int,kind:int,high:int>>, "
    "held array<bigint>, near array<struct<entity:bigint,term:bigint,around:bigint>>"
)


def find_values(texts: DataFrame, reach: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            base, held, near = [], [], []
            for text in part["text"]:
                spans = base_spans(text)
                base.append([{"low": s, "kind": k, "high": e} for s, k, e, _ in spans])
                held.append(sorted({_hash(k, value) for _, k, _, value in spans}))
                near.append(near_terms(text, spans, reach) if spans else [])
            yield pd.DataFrame({"_rid": part["_rid"], "_tag": part["_tag"], "base": base, "held": held, "near": near})

    return texts.mapInPandas(run, FOUND)


KNOWN_WORDS = 200_000


class _Terms(dict):
    """Word to hash of its term, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int | None:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        t = term(word)
        value = self[word] = None if t is None else _hash(t)
        return value


def term_texts(texts: DataFrame) -> DataFrame:
    """In how many texts every term of the corpus occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Terms()
        for part in batches:
            counts: Counter = Counter()
            for text in part["text"]:
                if text:
                    counts.update({known[w] for w in set(_WORD.findall(text))})
            counts.pop(None, None)
            yield pd.DataFrame({"term": list(counts.keys()), "n": list(counts.values())}, dtype="int64")

    return texts.mapInPandas(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("texts"))


def disclosures(found: DataFrame, texts: DataFrame, min_contexts: int, at: float) -> DataFrame:
    """Pairs (entity, term) whose share P(entity | term) reaches ``at``, with the share."""
    met = found.select(F.explode("near").alias("n")).select("n.entity", "n.term", "n.around")
    close = (
        met.groupBy("entity", "term", "around")
        .agg(F.count("*").alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("near_texts"), F.count("*").alias("contexts"))
        .where(F.col("contexts") >= min_contexts)
    )
    shares = close.join(term_texts(texts), "term").select(
        "entity", "term", (F.col("near_texts") / F.col("texts")).alias("share")
    )
    return shares.where(F.col("share") >= at)


#: Bits of the filter that tells which words need to meet the disclosing terms in a join.
FILTER_BITS = 1 << 23


def term_filter(told: DataFrame) -> np.ndarray:
    """One bit per remainder of a term; of fixed size, and never without a bit that belongs to a term."""
    place = F.pmod("term", F.lit(FILTER_BITS))
    words = (
        told.select(place.alias("place")).distinct()
        .groupBy(F.expr("place div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
        .collect()  # FILTER_BITS / 64 rows at most
    )
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in words:
        out[r["word"]] = r["bits"]
    return out


class _Listed(_Terms):
    """Word to hash of its term where the filter has it, else None."""

    def __init__(self, listed: np.ndarray):
        super().__init__()
        self.listed = listed

    def __missing__(self, word: str) -> int | None:
        value = super().__missing__(word)
        if value is not None:
            at = value % FILTER_BITS
            if not (int(self.listed[at >> 6]) >> (at & 63)) & 1:
                value = self[word] = None
        return value


def occurrences(texts: DataFrame, told: DataFrame) -> DataFrame:
    """Row key, term, low, high: every place in all whole texts, outside values, of a term the filter has."""
    listed = term_filter(told)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Listed(listed)
        for part in batches:
            out = []
            for rid, tag, text in zip(part["_rid"], part["_tag"], part["text"], strict=True):
                hits = {w: h for w in set(_WORD.findall(text or "")) if (h := known[w]) is not None}
                if hits:
                    starts, ends = _merged(base_spans(text))
                    out += [
                        (rid, tag, hits[m.group()], m.start(), m.end()) for m in _WORD.finditer(text)
                        if m.group() in hits and _outside(starts, ends, m.start(), m.end())
                    ]
            yield pd.DataFrame(out, columns=[*ROW_KEY, "term", "low", "high"], dtype="int64")

    return texts.mapInPandas(run, "_rid bigint, _tag int, term bigint, low int, high int")


def private_spans(
    docs: DataFrame,
    reach: int = REACH,
    min_contexts: int = MIN_CONTEXTS,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
) -> DataFrame:
    """Row key and ``spans``, sorted structs (low, kind, high), one row per input row.

    Kinds 0 to 3 are the patterns, 4 is a term to generalise, 5 a term to remove.  Places are code
    points, the end exclusive.  NULL and empty texts have no spans; repeated rows get equal spans;
    no rows give none; columns other than doc_id and text are not read.
    """
    texts = with_row_key(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select(*ROW_KEY, "text")
    found = materialize(find_values(texts, reach), "values")
    told = materialize(disclosures(found, texts.select("text"), min_contexts, generalise_at), "disclosures")
    terms = materialize(told.groupBy("term").agg(F.max("share").alias("share")), "terms")
    met = materialize(salted_join(occurrences(texts, told), terms, ["term"], "_rid"), "occurrences")
    everywhere = met.where(F.col("share") >= remove_at)
    # only terms below the upper threshold need their entities, once per text: at most twice the meetings counted
    weak = told.join(terms.where(F.col("share") < remove_at), "term", "left_semi").select("entity", "term")
    held = found.select(*ROW_KEY, F.explode("held").alias("entity"))
    pairs = met.where(F.col("share") < remove_at).select(*ROW_KEY, "term").distinct()
    beside = salted_join(pairs, weak, ["term"], "_rid").join(held, [*ROW_KEY, "entity"], "left_semi")
    general = met.join(beside.select(*ROW_KEY, "term").distinct(), [*ROW_KEY, "term"], "left_semi")
    marks = (
        everywhere.withColumn("kind", F.lit(5)).unionByName(general.withColumn("kind", F.lit(4)))
        .groupBy(*ROW_KEY)
        .agg(F.collect_set(F.struct("low", "kind", "high")).alias("marks"))
    )
    none = F.array().cast("array<struct<low:int,kind:int,high:int>>")
    return found.select(*ROW_KEY, "base").join(marks, ROW_KEY, "left").select(
        *ROW_KEY, F.sort_array(F.concat("base", F.coalesce("marks", none))).alias("spans")
    )


def span_list(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, GENERAL, REMOVED)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["low"], s["high"])), ","
    )


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < len(KINDS))


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def private_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id and spans, for reports that do not need the texts."""
    return private_spans(docs, **options).select(key_to_id(), "spans")


def shape(word: str) -> str:
    """The general term that stands for a word."""
    if any(c.isdigit() for c in word):
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else "[TERM]"


def rewrite(text: str, spans: list) -> str:
    """Values become their kind, terms their shape or nothing; overlapping spans are one."""
    out, done = [], 0
    for s in spans:
        low, kind, high = s["low"], s["kind"], s["high"]
        if low >= done:
            out.append(text[done:low])
            if kind < len(KINDS):
                out.append(f"[{KINDS[kind].upper()}]")
            elif kind == len(KINDS):
                out.append(shape(text[low:high]))
        done = max(done, high)
    out.append(text[done:])
    return "".join(out)


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """The documents with the columns of ``docs``, their texts without the private spans.

    A column n_chars, where there is one, follows the text.  Rows and NULL texts stay.
    """

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(s) else rewrite(t, s) for t, s in zip(texts, spans, strict=True)])

    spans = private_spans(docs, **options).where(F.size("spans") > 0).dropDuplicates(ROW_KEY)
    keyed = with_row_key(docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")).select(*ROW_KEY, "doc")
    met = keyed.join(spans, ROW_KEY, "left")
    text = F.col("doc.text").cast("string")
    rows = met.select(
        "doc", F.when(F.col("spans").isNull(), text).otherwise(rewritten(text, F.coalesce("spans", F.array().cast(
            "array<struct<low:int,kind:int,high:int>>")))).alias("text"),
    )
    out = []
    for c, kind in docs.dtypes:
        if c == "text":
            out.append(F.col("text"))
        elif c == "n_chars":
            out.append(F.length("text").cast(kind).alias(c))
        else:
            out.append(F.col(f"doc.`{c}`").alias(c))
    return rows.select(*out)
