"""Exact removal of repeated passages, found through difference-cover anchors.

A difference cover D of a period v holds, for any two positions i and j, a shift s < v such that
both i + s and j + s fall on D modulo v.  So when two windows of ``window`` words are equal, some
anchor of ``window - v + 1`` words that starts at a cover position of both lies inside them.  Only
anchors at cover positions are hashed and counted.  Around anchors seen twice, the match is
extended: every window that holds such an anchor is hashed whole (96 bits) and counted.

Equal hashes within one batch are merged before the shuffle, so a passage that a third of all
documents hold reaches a task once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, ids_are_keys, key_to_id, with_row_key
from .words import Windows, WordHasher, encoded_words, mix

#: A perfect difference set: every residue modulo 21 is a difference of two of its members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
WINDOW = 35

_THIRD = np.uint64(0xC2B2AE3D27D4EB4F)


def _occurrences(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags per element: first of its value, value seen more than once."""
    _, first_at, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    first = np.zeros(len(keys), dtype=bool)
    first[first_at] = True
    return first, counts[inverse] > 1


def _spans(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge overlapping or touching ranges [low, high] of the same document; input sorted by both."""
    if not len(doc):
        return doc, low, high
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > high[:-1] + 1)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(doc)) - 1
    return doc[start], low[start], high[last]


#: Four longs a row: the shuffles carry tens of such rows per hundred words.  ``place`` holds the
#: first start, and above bit 40 how many more follow; ``mark`` the tag, and above bit 32 more hash.
ROWS = "h bigint, _rid bigint, mark bigint, place bigint, known boolean"
_LONGEST = (1 << 22) - 1


def _frame(
    part: pd.DataFrame, doc: np.ndarray, low: np.ndarray, high: np.ndarray, h: np.ndarray, g: np.ndarray, known: bool
) -> pd.DataFrame:
    tag = part["_tag"].to_numpy(dtype=np.int64)[doc]
    return pd.DataFrame({
        "h": h.view(np.int64), "_rid": part["_rid"].to_numpy()[doc], "mark": (g.astype(np.int64) << 32) | tag,
        "place": low.astype(np.int64) | ((high - low).astype(np.int64) << 40), "known": known,
    })


def _rows(
    part: pd.DataFrame, doc: np.ndarray, low: np.ndarray, high: np.ndarray, h: np.ndarray, g: np.ndarray
) -> Iterator[pd.DataFrame]:
    """One row per distinct hash to be counted elsewhere, and what this batch alone settles, as ranges."""
    if not len(doc):
        return
    first, often = _occurrences(h)
    yield _frame(part, doc[first], low[first], high[first], h[first], g[first], known=False)
    d, a, b = _spans(doc[often], low[often], high[often])
    while len(d):
        # a range is written in steps of at most _LONGEST starts
        end = np.minimum(b, a + _LONGEST)
        yield _frame(part, d, a, end, mix(part["_rid"].to_numpy()[d].astype(np.uint64)), np.zeros(len(d)), known=True)
        d, a, b = d[end < b], end[end < b] + 1, b[end < b]


def _starts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of each place."""
    places = np.asarray(places, dtype=np.int64)
    low = places & ((1 << 40) - 1)
    return low, low + (places >> 40)


def anchor_rows(window: int, period: int, cover: tuple[int, ...]):
    """Anchors at cover positions; low..high are the starts of the windows that hold the anchor."""
    length = window - period + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, slices = WordHasher(), Windows()
        on_cover = np.zeros(period, dtype=bool)
        on_cover[list(cover)] = True
        for part in batches:
            found = []
            for first, words, bounds in hasher.chunks(part["text"].tolist()):
                sizes = np.diff(bounds)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(len(words)) - bounds[doc]
                size = sizes[doc]
                start = np.flatnonzero(on_cover[at % period] & (at + length <= size) & (size >= window))
                h = slices.slices(words, start, start + length)
                d, p, n = doc[start], at[start], size[start]
                found.append((d + first, np.maximum(p - period + 1, 0), np.minimum(p, n - window), h))
            if found:
                doc, low, high, h = (np.concatenate(x) for x in zip(*found, strict=True))
                # 48 bits: anchors only point at candidates, and shorter numbers shuffle less
                yield from _rows(part, doc, low, high, h >> np.uint64(16), np.zeros(len(h)))

    return run


def window_rows(window: int):
    """Whole windows at the candidate starts of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, one, two = WordHasher(), Windows(), Windows(_THIRD)
        for part in batches:
            places = part["places"].tolist()
            found = []
            for first, words, bounds in hasher.chunks(part["text"].tolist()):
                wanted = np.zeros(len(words) + 1, dtype=np.int64)
                for i in range(len(bounds) - 1):
                    low, high = _starts(places[first + i])
                    np.add.at(wanted, low + bounds[i], 1)
                    np.add.at(wanted, high + bounds[i] + 1, -1)
                start = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                doc = np.searchsorted(bounds, start, side="right") - 1
                at = start - bounds[doc]
                h = one.slices(words, start, start + window)
                g = two.slices(mix(words ^ _THIRD), start, start + window)
                found.append((doc + first, at, h, (g >> np.uint64(33)).astype(np.int64)))
            if found:
                doc, at, h, g = (np.concatenate(x) for x in zip(*found, strict=True))
                yield from _rows(part, doc, at, at, h, g)

    return run


def kept_rows(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            total, removed, kept = [], [], []
            for text, places in zip(part["text"], part["places"], strict=True):
                words = encoded_words(text)
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                low, high = _starts(places if places is not None else [])
                np.add.at(gone, low, 1)
                np.add.at(gone, high + window, -1)
                stay = np.cumsum(gone)[:-1] == 0
                total.append(len(words))
                removed.append(len(words) - int(stay.sum()))
                left = words if not removed[-1] else [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({
                "_rid": part["_rid"], "_tag": part["_tag"], "n_words": total, "n_removed": removed, "kept_text": kept,
            })

    return run


def repeated_spans(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per document: places whose hash occurs at least twice, or was settled in its batch."""
    # dealt by h before the rest of the hash is taken out of ``mark``, so that no row travels wider
    dealt = rows.repartition("h").withColumn("g", F.shiftright("mark", 32))
    counted = dealt.withColumn("n", F.count("*").over(Window.partitionBy("h", "g")))
    tag = F.col("mark").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return (
        counted.where("known or n > 1").select("_rid", tag.alias("_tag"), "place")
        .groupBy(*key).agg(F.collect_list("place").alias("places"))
    )


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text, one row per input row.

    A word goes if a window of ``window`` words that covers it starts anywhere else, in the same
    document or another; all copies go.  NULL texts have no words and keep an empty text; texts
    shorter than a window stay; repeated rows are copies of each other; no rows give none; other
    columns are not read.
    """
    if window < period:
        raise ValueError("a window must be at least as long as the period")
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    plain = ids_are_keys(picked)
    key = ROW_KEY[:1] if plain else ROW_KEY
    texts = with_row_key(picked, plain).select(*ROW_KEY, "text")
    anchors = texts.where("text is not null").mapInPandas(anchor_rows(window, period, cover), ROWS)
    # both joins need the texts dealt by the row key: Spark shuffles them once and reads them twice
    around = texts.join(repeated_spans(anchors, key), key).select(*ROW_KEY, "text", "places")
    windows = around.mapInPandas(window_rows(window), ROWS)
    gone = repeated_spans(windows, key)
    out = texts.join(gone, key, "left").select(*ROW_KEY, "text", "places").mapInPandas(
        kept_rows(window), "_rid bigint, _tag int, n_words bigint, n_removed bigint, kept_text string"
    )
    return out.select(key_to_id(), "n_words", "n_removed", "kept_text")
