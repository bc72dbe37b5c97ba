"""Language identification by a small convolutional network over bytes, trained in numpy.

Bytes are embedded, filters of several widths slide over windows of fixed length, each filter
keeps its largest response in the window, and a softmax layer reads those.  A text is cut into
windows from its first to its last byte; its languages are the mean of its windows' softmax.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 10
DIMENSIONS = 5
#: Different windows trained on at most, for each language: a bounded sample, those with the smallest
#: hashes among all windows, first to last, of the texts drawn.
TRAIN_WINDOWS = 1500
#: Languages learned at most, the most frequent ones.
MAX_LANGUAGES = 1000
EPOCHS = 4
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def windows_of(text: str, length: int = LENGTH) -> np.ndarray:
    """All windows of a text, the last one padded with zero bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-len(raw) // length))
    out = np.zeros(n * length, dtype=np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, length)


@dataclass
class Network:
    """Weights; filters narrower than the widest one are zero where they do not reach."""

    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    languages: list[str]

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Response of every filter at every position, and the embedded windows."""
        widest, dim = max(WIDTHS), self.embedding.shape[1]
        e = self.embedding[np.pad(x, ((0, 0), (0, widest - 1)))]
        flat = e.reshape(len(x), -1)
        columns = np.lib.stride_tricks.sliding_window_view(flat, widest * dim, axis=1)[:, ::dim]
        return columns.reshape(-1, widest * dim) @ self.kernel, flat

    def pooled(self, x: np.ndarray) -> np.ndarray:
        found, _ = self.responses(x)
        return np.maximum(found.reshape(len(x), x.shape[1], -1).max(axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(x) @ self.dense + self.dense_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def kernel_mask(dim: int) -> np.ndarray:
    mask = np.zeros((max(WIDTHS) * dim, FILTERS * len(WIDTHS)), dtype=np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * dim, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


def gradients(net: Network, bx: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
    """Gradient of the mean cross-entropy for every weight; it flows through the position that won the pooling only."""
    widest, dim, filters = max(WIDTHS), net.embedding.shape[1], net.kernel.shape[1]
    found, _ = net.responses(bx)
    found = found.reshape(len(bx), bx.shape[1], filters)
    where = found.argmax(axis=1)
    top = np.take_along_axis(found, where[:, None, :], axis=1)[:, 0] + net.bias
    pooled = np.maximum(top, 0)
    delta = softmax(pooled @ net.dense + net.dense_bias)
    delta[np.arange(len(bx)), by] -= 1
    delta /= len(bx)
    back = (delta @ net.dense.T) * (top > 0)
    # the window of bytes behind every winner: (batch, filters, widest)
    at_bytes = where[:, :, None] + np.arange(widest)
    padded = np.pad(bx, ((0, 0), (0, widest - 1)))
    chosen = padded[np.arange(len(bx))[:, None, None], at_bytes]
    columns = net.embedding[chosen].reshape(len(bx), filters, widest * dim)
    g_kernel = np.einsum("bf,bfk->kf", back, columns) * kernel_mask(dim)
    g_bytes = np.einsum("bf,kf->bfk", back, net.kernel).reshape(-1, dim)
    g_embedding = np.zeros_like(net.embedding)
    np.add.at(g_embedding, chosen.reshape(-1), g_bytes)
    g_embedding[0] = 0
    return [g_embedding, g_kernel, back.sum(axis=0), pooled.T @ delta, delta.sum(axis=0)]


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    widest, dim, filters = max(WIDTHS), DIMENSIONS, FILTERS * len(WIDTHS)
    mask = kernel_mask(dim)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    net = Network(
        normal(256, dim, scale=0.5), normal(widest * dim, filters, scale=0.3) * mask, np.zeros(filters, np.float32),
        normal(filters, len(languages), scale=0.2), np.zeros(len(languages), np.float32), languages,
    )
    net.embedding[0] = 0
    params = [net.embedding, net.kernel, net.bias, net.dense, net.dense_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, rate, size = 0, 0.01, 64
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), size):
            batch = order[at : at + size]
            bx, by = x[batch], y[batch]
            grads = gradients(net, bx, by)
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        rate *= 0.6
    return net


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def training_windows(docs: DataFrame, per_language: int = TRAIN_WINDOWS) -> pd.DataFrame:
    """Windows of learnable documents with their languages.

    Different texts whose hash falls below the share that gives ``per_language`` / 2 of them are
    cut up whole, so only the sample is shuffled; of their different windows the ``per_language``
    with the smallest hashes stay for every language.  A text hands on no more than that many,
    which loses none of them.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for text, lang in zip(part["text"], part["lang"], strict=True):
                hashed = {(xxhash.xxh64_intdigest(w.tobytes()) >> 1, w.tobytes()) for w in windows_of(text)}
                rows += [(lang, *x) for x in heapq.nsmallest(per_language, hashed)]
            yield pd.DataFrame(rows, columns=["lang", "h", "window"])

    learnable = docs.where("text is not null and lang is not null").where(fold(F.col("doc_id")) != 1)
    hashed = learnable.select("lang", "text", F.xxhash64("text").alias("h"))
    shares = (
        learnable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
        .select("lang", (F.lit(per_language / 2) / F.col("n")).alias("share"))
    )
    below = F.col("h") / float(1 << 64) + 0.5 < F.col("share")
    # at most MAX_LANGUAGES rows; a shuffle by language would move every text
    chosen = hashed.join(F.broadcast(shares), "lang").where(below).dropDuplicates(["lang", "h"])
    by_window = Window.partitionBy("lang").orderBy("h", "window")
    cut_up = chosen.select("lang", "text").mapInPandas(cut, "lang string, h bigint, window binary")
    return (
        cut_up.distinct().withColumn("n", F.row_number().over(by_window)).where(F.col("n") <= per_language)
        .select("lang", "window").toPandas()
    )


def fit(docs: DataFrame, per_language: int = TRAIN_WINDOWS) -> Network | None:
    sample = training_windows(docs, per_language)
    if not len(sample):
        return None
    sample = sample.sort_values(["lang", "window"], ignore_index=True)
    languages = sorted(sample["lang"].unique())
    x = np.frombuffer(b"".join(sample["window"]), dtype=np.uint8).reshape(-1, LENGTH)
    return train(x, sample["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy(), languages)


BLOCK = 256


def identify(network: Network | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of every text, BLOCK windows at a time."""
    known = [i for i, t in enumerate(texts) if network is not None and t and _LETTER.search(t)]
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not known:
        return names, scores
    total = np.zeros((len(texts), len(network.languages)))
    held: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        np.add.at(total, owners, network.probabilities(np.concatenate(held)))
        held.clear()
        owners.clear()

    for i in known:
        windows = windows_of(texts[i])
        for at in range(0, len(windows), BLOCK):
            held.append(windows[at : at + BLOCK])
            owners.extend([i] * len(held[-1]))
            if len(owners) >= BLOCK:
                flush()
    if held:
        flush()
    for i in known:
        best = int(total[i].argmax())
        names[i], scores[i] = network.languages[best], min(1.0, total[i, best] / total[i].sum())
    return names, scores


def predict_languages(docs: DataFrame, per_language: int = TRAIN_WINDOWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row per input row.

    Learned from documents outside the held-out fold that have a language; prediction reads the
    text alone.  NULL texts and texts without letters are 'und' with score 0, as is everything if
    no language can be learned.  Repeated rows are judged alike; no rows give none; a row without
    doc_id falls in the fold of the empty string.
    """
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, per_language))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            names, scores = identify(shared.value, part["text"].tolist())
            yield pd.DataFrame({
                "doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": names, "score": scores,
            })

    # ids travel as strings: pandas has no long with NULLs
    return texts.select(F.col("doc_id").cast("string"), (fold(F.col("doc_id")) == 1).alias("held_out"), "text").mapInPandas(
        run, "doc_id string, held_out boolean, lang_pred string, score double"
    ).withColumn("doc_id", F.col("doc_id").cast("bigint"))
