"""Importance resampling of raw text towards a target, by hashed n-gram models.

Two bags of hashed word and word-pair counts are made: one of labelled target documents, one of
all documents.  A document's log-weight is the sum of the log-ratios of its n-grams; texts above
``NGRAMS`` n-grams count as if they had that many, so that length alone decides nothing.  Gumbel
noise is added and the top k stay: a sample without replacement in proportion to the weights.
k is the expected number of documents that rejection sampling would accept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import WordHasher, mix

#: Labelled documents the target model is fitted on at most, those with the smallest hashes of their ids.
TARGET_DOCS = 20_000
MOST_BUCKETS = 1 << 16
#: Buckets are merged until the target has this many n-grams per bucket.
PER_BUCKET = 64
#: The target model is pulled towards the raw one by this share of its own size.
PRIOR = 0.25
NGRAMS = 50
#: Log-weight from which on a document is accepted for certain.
CERTAIN = -5.0
BINS = 1024

_PAIR = np.uint64(0x9E3779B97F4A7C15)


def ngrams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, buckets of all n-grams, index of the text each belongs to), chunk by chunk."""
    for first, words, bounds in WordHasher(split_marks=True, fold=True).chunks(texts):
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        same = np.flatnonzero(doc[:-1] == doc[1:]) if len(doc) else np.zeros(0, dtype=np.int64)
        pairs = mix(words[same] * _PAIR + words[same + 1])
        hashed = np.concatenate([words, pairs]) % np.uint64(MOST_BUCKETS)
        yield first, hashed.astype(np.int64), np.concatenate([doc, doc[same]])


def bucket_counts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows (bucket, raw, target) over every document; at most MOST_BUCKETS rows leave a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(MOST_BUCKETS, dtype=np.int64), np.zeros(MOST_BUCKETS, dtype=np.int64)
        for part in batches:
            wanted = part["wanted"].to_numpy(dtype=bool)
            for first, buckets, doc in ngrams(part["text"].tolist()):
                raw += np.bincount(buckets, minlength=MOST_BUCKETS)
                target += np.bincount(buckets[wanted[first + doc]], minlength=MOST_BUCKETS)
        used = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": used, "raw": raw[used], "target": target[used]})

    # ``chosen`` has at most TARGET_DOCS rows
    flagged = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select(
        "text", F.coalesce("wanted", F.lit(False)).alias("wanted")
    )
    return (
        flagged.mapInPandas(run, "bucket bigint, raw bigint, target bigint")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def log_ratios(counts: pd.DataFrame, per_bucket: int = PER_BUCKET, prior: float = PRIOR) -> np.ndarray:
    """Log-ratio of target to raw for every bucket; all 0 without target documents."""
    raw, target = np.zeros(MOST_BUCKETS), np.zeros(MOST_BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    n = int(target.sum())
    if not n:
        return np.zeros(MOST_BUCKETS)
    size = min(MOST_BUCKETS, max(64, 1 << int(math.log2(max(1, n // per_bucket)))))
    raw, target = raw.reshape(-1, size).sum(axis=0), target.reshape(-1, size).sum(axis=0)
    share = (raw + 1) / (raw.sum() + size)
    pulled = (target + prior * n * share) / (n + prior * n)
    return np.tile(np.log(pulled / share), MOST_BUCKETS // size)


def fit(docs: DataFrame, labels: DataFrame, target_docs: int = TARGET_DOCS) -> np.ndarray:
    chosen = (
        labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint")).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs).withColumn("wanted", F.lit(True))
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return log_ratios(bucket_counts(texts, materialize(chosen, "target")).toPandas())


def scorer(docs: DataFrame, ratios: np.ndarray):
    """A column function: the log-weight of a text; texts without n-grams have 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("double")
    def log_weight(texts: pd.Series) -> pd.Series:
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        for first, buckets, doc in ngrams(texts.tolist()):
            found = np.bincount(doc, weights=shared.value[buckets])
            sums[first : first + len(found)] += found
            counts[first : first + len(found)] += np.bincount(doc)
        return pd.Series(np.round(sums / np.maximum(1.0, counts / NGRAMS), 6))

    return log_weight


def gumbel(key: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """Exact k-th largest value; only histograms of BINS rows reach the driver."""
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return math.inf
    if k >= n:
        return low
    while low < high:
        width = (high - low) / BINS
        at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        bins = (
            values.where(F.col(column).between(low, high)).groupBy(at.alias("bin"))
            .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .orderBy(F.desc("bin")).collect()
        )
        for b in bins:
            if b["n"] >= k:
                low, high = b["low"], b["high"]
                break
            k -= b["n"]
    return low


def _threshold(docs: DataFrame, log_weight, certain: float, seed: int) -> tuple[DataFrame, float]:
    scored = materialize(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), log_weight(F.col("text").cast("string")).alias("log_weight")
        ).withColumn("score", F.col("log_weight") + gumbel(F.col("doc_id"), seed)),
        "weights",
    )
    expected = scored.agg(F.sum(F.exp(F.least(F.col("log_weight") - certain, F.lit(0.0))))).first()[0] or 0.0
    return scored, kth_largest(scored, "score", round(expected))


def importance_weights(docs: DataFrame, labels: DataFrame, certain: float = CERTAIN, seed: int = 5) -> DataFrame:
    """doc_id, log_weight, score (with noise) and kept, one row per input row.

    NULL and blank texts have log-weight 0; rows without doc_id share one draw of noise, as do
    repeated rows; rows that tie with the last one kept stay.  Without labelled target documents
    all weights are equal and all rows stay; no rows give none; other columns are not read.
    """
    scored, least = _threshold(docs, scorer(docs, fit(docs, labels)), certain, seed)
    return scored.select("doc_id", "log_weight", "score", (F.col("score") >= F.lit(least)).alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame, certain: float = CERTAIN, seed: int = 5) -> DataFrame:
    """The documents that stay, with the columns of ``docs``.

    Texts are weighed again where they lie, instead of joining the decisions to them.
    """
    log_weight = scorer(docs, fit(docs, labels))
    _, least = _threshold(docs, log_weight, certain, seed)
    noise = gumbel(F.col("doc_id").cast("bigint"), seed)
    return docs.where(log_weight(F.col("text").cast("string")) + noise >= F.lit(least))
