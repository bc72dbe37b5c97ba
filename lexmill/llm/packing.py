"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut at the longest length.  Pieces go, longest first, into the open bin with the
least room that holds them.  If none does, a bin is opened at the length whose cost, less the
worth of the room that pieces still to come can fill, is least.  At the end every bin shrinks to
the shortest permitted length that holds its contents.

Bins are filled shard by shard; a shard is a bounded number of words, however large the corpus.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import count_words, encoded_words

LENGTHS = (512, 1024, 2048, 4096)
#: Words of a shard, on average.
SHARD_WORDS = 1 << 17
OPENING, SQUARE = 64, 8192
_BINS_PER_SHARD = 1 << 24


def cost(length: int) -> float:
    """What a sequence costs to train on: a fixed part, a linear one and the square of attention."""
    return OPENING + length + length * length / SQUARE


def pieces(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, length) of every piece; an item without words has none."""
    count = -(-sizes // longest)
    item = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    start = number * longest
    return item, start, np.minimum(longest, sizes[item] - start)


def open_length(size: int, coming: int, lengths: tuple[int, ...]) -> int:
    """The permitted length for a new bin; the shorter one if two cost the same."""
    worth = min(cost(c) / c for c in lengths)
    return min((c for c in lengths if c >= size), key=lambda c: (cost(c) - worth * min(c - size, coming), c))


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every piece, in the order given (longest first), and the final bin lengths."""
    lengths = tuple(sorted(lengths))
    rooms: list[tuple[int, int]] = []
    used: list[int] = []
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    coming = int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        coming -= size
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = open_length(size, coming, lengths), len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if room > size:
            insort(rooms, (room - size, b))
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


SLOTS = "doc_id bigint, no_id boolean, start bigint, n_words bigint, bin_id bigint, bin_offset bigint, capacity bigint"


def pack(
    docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_words: int = SHARD_WORDS, with_text: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start and n_words in it, bin_id, bin_offset and capacity, and its text on request.

    Every word of every row is packed once.  NULL and blank texts have nothing to pack; a NULL
    doc_id stays NULL; repeated rows are packed each; ties go by doc_id, then start; no rows give
    none; other columns are not read.  ``lengths`` are distinct positive numbers.

    Equal rows share a shard unless they alone would fill one: then they are dealt over as many
    shards as their words need.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
        count_words(text).alias("size"),
        F.xxhash64("doc_id", text).alias("mark"), *([text.alias("text")] if with_text else []),
    )
    sized = rows.where("size > 0")
    marks = materialize(sized.groupBy("mark").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "marks")
    total = marks.agg(F.sum("words")).first()[0] or 0
    shards = int(total // shard_words) + 1
    # written, so that Spark knows its size before it plans the join
    hot = materialize(
        marks.where((F.col("n") > 1) & (F.col("words") > shard_words))
        .select("mark", F.least(F.lit(shards), F.ceil(F.col("words") / shard_words)).alias("spread")),
        "hot-rows",
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["no_id", "doc_id", "mark"], ignore_index=True)
        item, start, size = pieces(group["size"].to_numpy(), max(lengths))
        order = np.lexsort((start, item, -size))
        item, start, size = item[order], start[order], size[order]
        bins, offsets, capacity = best_fit(size, lengths)
        out = pd.DataFrame({
            "doc_id": group["doc_id"].to_numpy()[item], "no_id": group["no_id"].to_numpy()[item],
            "start": start, "n_words": size,
            "bin_id": bins + int(group["shard"].iloc[0]) * _BINS_PER_SHARD, "bin_offset": offsets,
            "capacity": np.array(capacity, dtype=np.int64)[bins],
        })
        if with_text:
            texts = [""] * len(item)
            for at in np.argsort(item, kind="stable"):
                i = item[at]
                if start[at] == 0 and size[at] == group["size"].iloc[i]:
                    texts[at] = group["text"].iloc[i]
            cut = {i for i, t in zip(item.tolist(), texts, strict=True) if not t}
            words = {i: encoded_words(group["text"].iloc[i]) for i in cut}
            for at, (i, s, n) in enumerate(zip(item.tolist(), start.tolist(), size.tolist(), strict=True)):
                if not texts[at]:
                    texts[at] = b" ".join(words[i][s : s + n]).decode("utf-8", "surrogatepass")
            out["text"] = texts
        return out

    # rows of one mark are equal, so it does not matter which of them goes where
    sharded = (
        sized.withColumn("turn", F.monotonically_increasing_id()).join(hot, "mark", "left")
        .withColumn("shard", F.pmod(F.col("mark") + F.coalesce(F.pmod("turn", "spread"), F.lit(0)), F.lit(shards)))
        .drop("turn", "spread")
    )
    packed = sharded.groupBy("shard").applyInPandas(run, SLOTS + (", text string" if with_text else ""))
    return packed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
