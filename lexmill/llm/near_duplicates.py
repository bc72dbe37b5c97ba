"""Near-duplicate documents through a byte-position inverted index with count filtering, where many bits can differ.

Shingles of five words at a Jaccard similarity of 0.8 differ in about 15 % of all SimHash bits, so 64
bits are too few to guarantee a shared byte.  Fingerprints here have 256 positional bytes, of which a pair
at 0.8 shares 69 on average, with a deviation of 7.  The index holds all of them in 128 couples and lists a
document under each couple: a pair shares a given couple with probability 0.07, and with more than 128
shared bytes always one.  Within a list the shared bytes of a pair are tallied, on 24 others, and pairs
below the minimum are left out; a list gives a spanning forest of what is left.  These links only say which
documents may belong together: the forest connects whatever any pair of the list connects.  Inside
each cluster of such links the shared bytes of all pairs are then tallied on all 256 positions; pairs below
the minimum for the similarity are left out, and the rest is decided on the distinct shingles of both texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, ids_are_keys, materialize, parallelism, with_row_key
from .components import components, contracted
from .simhash import agreeing_bytes, majority, runs
from .words import Windows, WordHasher, mix

WORDS, SIMILARITY = 5, 0.8
FINGERPRINT_WORDS = 32
POSITIONS = 8 * FINGERPRINT_WORDS
COUPLES = POSITIONS // 2
#: Fingerprint words that a list carries for its tally, and the bytes of them that a pair has to share beside the couple:
#: 6.4 expected at 0.8 (short of the minimum in one list of ten), 0.1 for unrelated texts.
HEAD_WORDS, HEAD_SHARED = 3, 4
#: Deviations below the expected tally at which pairs are counted out.
DEVIATIONS = 4
#: Texts with fewer shingles are not counted out: bits that so few decide are no coin tosses.
COUNTED_FROM = 64
LONG, TILE = 24, 8192
#: Links that a task gathers before it turns them into stars.
STAR_ROWS = 500_000
#: Texts and shingles of a cluster that one task compares; larger clusters are cut into tiles that meet pairwise.
CLUSTER_TEXTS, CLUSTER_SHINGLES = 2048, 2_000_000
#: Bits of the filter that keeps texts outside all clusters out of a shuffle.
FILTER_BITS = 1 << 23

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Distinct shingles of texts as sorted 64-bit hashes; texts shorter than a shingle are one."""

    def __init__(self, words: int):
        self.words, self._hasher, self._slices = words, WordHasher(fold=True), Windows()

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for _, hashes, bounds in self._hasher.chunks(texts):
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                start = np.arange(max(min(1, high - low), high - low - self.words + 1))
                yield np.unique(self._slices.slices(hashes[low:high], start, np.minimum(start + self.words, high - low)))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Per row: key, a hash of its set of shingles (node), their number n, and the fingerprint as binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words)
        steps = np.arange(1, FINGERPRINT_WORDS, dtype=np.uint64) * _GOLDEN
        for part in batches:
            node, n, prints = [], [], []
            for h in shingles.sets(part["text"].tolist()):
                node.append(xxhash.xxh64_intdigest(h.tobytes()))
                n.append(len(h))
                wide = np.column_stack([h, mix(h[:, None] + steps)])
                prints.append(majority(wide).tobytes() if len(h) else bytes(8 * FINGERPRINT_WORDS))
            nodes = np.array(node, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"_rid": part["_rid"], "_tag": part["_tag"], "node": nodes, "n": n, "sketch": prints})

    return docs.mapInPandas(run, "_rid bigint, _tag int, node bigint, n bigint, sketch binary")


HEADS = [f"w{i}" for i in range(HEAD_WORDS)]


def index_lists(nodes: DataFrame) -> DataFrame:
    """One row per class of equal sets of shingles and couple of bytes: the list's key, the class, and bytes for the tally."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = np.arange(COUPLES)
        lists = number.astype(np.int64) << 16
        # every list tallies bytes of its own, none of them from its couple's word, so a pair that one misjudges another sees
        first = number // 4 + 1 + 5 * number % (FINGERPRINT_WORDS - HEAD_WORDS)
        for part in batches:
            for at in range(0, len(part), 2048):
                piece = part.iloc[at : at + 2048]
                raw = np.frombuffer(b"".join(piece["sketch"]), dtype=np.uint8).reshape(len(piece), -1)
                key = lists + raw.view(np.uint16).astype(np.int64)
                words = raw.view(np.int64)
                held = {w: words[:, (first + i) % FINGERPRINT_WORDS].ravel() for i, w in enumerate(HEADS)}
                yield pd.DataFrame({"key": key.ravel(), "node": np.repeat(piece["node"].to_numpy(), COUPLES), **held})

    return nodes.select("node", "sketch").mapInPandas(run, "key bigint, node bigint, " + ", ".join(f"{w} bigint" for w in HEADS))


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def shared_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The tally of equal positional bytes."""
    return agreeing_bytes(np.ascontiguousarray(x ^ y)).sum(axis=-1)


def least_shared(similarity: float) -> int:
    """The tally of all positions that pairs of ``similarity`` reach, whatever their sizes."""
    # sets of unequal size have a larger cosine at the same similarity
    same = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** 8
    return max(0, math.floor(POSITIONS * same - DEVIATIONS * math.sqrt(POSITIONS * same * (1 - same))))


def cheapest_forest(i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Kruskal over found links; every row lies in one list, so one pass serves all lists."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    keep = []
    for at in np.argsort(bits, kind="stable").tolist():
        p, q = root(int(i[at])), root(int(j[at]))
        if p != q:
            parent[p] = q
            keep.append(at)
    return np.array(keep, dtype=np.int64)


def prim(heads: np.ndarray, limit: int, minimum: int = 0) -> list[tuple[int, int]]:
    """Minimum spanning forest of one long list: the closest links among those within ``limit`` bits that share ``minimum`` bytes."""
    n = len(heads)
    best, via, out = np.full(n, limit + 1), np.full(n, -1), []
    outside = np.ones(n, dtype=bool)
    for _ in range(n):
        open_rows = np.flatnonzero(outside)
        at = int(open_rows[best[open_rows].argmin()])
        outside[at] = False
        if via[at] >= 0:
            out.append((int(via[at]), at))
        d = differing(heads, heads[at])
        closer = np.flatnonzero(outside & (d <= limit) & (d < best))
        closer = closer[shared_bytes(heads[closer], heads[at]) >= minimum]
        best[closer], via[closer] = d[closer], at
    return out


def list_links(block: pd.DataFrame, minimum: int) -> pd.DataFrame:
    """Links that connect what the tally leaves of each list of a sorted block: short lists together, long ones one by one."""
    key, node = block["key"].to_numpy(), block["node"].to_numpy()
    heads = np.column_stack([block[w].to_numpy() for w in HEADS]).view(np.uint64)
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    sizes = np.diff(np.append(starts, len(key)))
    short = np.flatnonzero(np.repeat(sizes, sizes) <= LONG)
    k, found = key[short], []
    for step in range(1, min(LONG, int(sizes.max()))):
        at = np.flatnonzero(k[step:] == k[:-step])
        if not len(at):
            break
        i, j = short[at], short[at + step]
        hit = shared_bytes(heads[i], heads[j]) >= minimum
        found.append((i[hit], j[hit], differing(heads[i[hit]], heads[j[hit]])))
    i, j, bits = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    keep = cheapest_forest(i, j, bits)
    pairs = [(i[keep], j[keep])]
    for s, n in zip(starts[sizes > LONG], sizes[sizes > LONG], strict=True):
        tree = np.array(prim(heads[s : s + n], 64 * HEAD_WORDS, minimum), dtype=np.int64).reshape(-1, 2) + s
        pairs.append((tree[:, 0], tree[:, 1]))
    left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return pd.DataFrame({"a": node[left], "b": node[right]})


def as_stars(links: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lists of a task propose clusters together, STAR_ROWS links at a time: a member is linked once to the smallest."""
    held, size = [], 0

    def star() -> pd.DataFrame:
        member, least = contracted(*(np.concatenate([x[c].to_numpy() for x in held]) for c in ("a", "b")))
        return pd.DataFrame({"a": least, "b": member})

    for frame in links:
        held.append(frame)
        size += len(frame)
        if size >= STAR_ROWS:
            yield star()
            held, size = [], 0
    if size:
        yield star()


def candidates(nodes: DataFrame, minimum: int = HEAD_SHARED, tile: int = TILE) -> DataFrame:
    """Distinct pairs of classes that a list links; lists above ``tile`` rows meet tile by tile."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        long_keys = []

        def short() -> Iterator[pd.DataFrame]:
            for block, part_of_long in runs(batches, tile):
                yield list_links(block, minimum)
                if part_of_long:
                    long_keys.append(int(block["key"].iloc[0]))

        for frame in as_stars(short()):
            yield frame.assign(long_key=None)
        if long_keys:
            yield pd.DataFrame({"a": None, "b": None, "long_key": long_keys})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from as_stars(list_links(block, minimum) for block, _ in runs(batches, 1 << 62))

    n = parallelism(nodes.sparkSession)
    lists = index_lists(nodes)
    found = materialize(
        lists.repartition(n, "key").sortWithinPartitions("key").mapInPandas(scan, "a bigint, b bigint, long_key bigint"),
        "near",
    )
    pairs = found.where("long_key is null").select("a", "b")
    long_keys = found.where("long_key is not null").groupBy("long_key").agg(F.count("*").alias("tiles"))
    if not long_keys.isEmpty():
        parts = (
            lists.join(long_keys, lists["key"] == long_keys["long_key"])
            .withColumn("part", F.pmod(F.xxhash64("node"), 2 * F.col("tiles")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), 2 * F.col("tiles") - 1)))
            .withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
            .select("key", "node", *HEADS)
        )
        more = parts.repartition(n, "key").sortWithinPartitions("key").mapInPandas(whole, "a bigint, b bigint")
        pairs = pairs.union(more)
    return pairs.distinct()


def exact_forest(sketch: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of all pairs of texts whose distinct shingles reach ``similarity``.

    Pairs whose tally of shared bytes is below the minimum are counted out, the others are decided on
    their shingles, the largest tally first; pairs that are already connected are left out.  With
    ``side``, only texts of different sides are compared.
    """
    n = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(n)])
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    held, label, out = np.zeros(len(known), dtype=np.int32), np.arange(len(sets)), []
    minimum = np.where(n < COUNTED_FROM, 0, least_shared(similarity))
    for i in range(len(sets) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if side is not None:
            j = j[side[j] != side[i]]
        j = j[np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i]) - 1e-9]
        tally = shared_bytes(sketch[j], sketch[i])
        order = np.argsort(-tally, kind="stable")
        j = j[order[tally[order] >= np.minimum(minimum[j[order]], minimum[i])]]
        held[codes[bounds[i] : bounds[i + 1]]] = 1
        step = 16
        while len(j):
            now, j = j[:step], j[step:]
            flat = np.concatenate([codes[bounds[k] : bounds[k + 1]] for k in now.tolist()])
            shared = np.add.reduceat(held[flat], np.concatenate([[0], np.cumsum(n[now])[:-1]]))
            for k in now[shared >= similarity * (n[i] + n[now] - shared) - 1e-9].tolist():
                if label[k] != label[i]:
                    out.append((i, k))
                    label[label == label[k]] = label[i]
            j = j[label[j] != label[i]]
            step *= 4
        held[codes[bounds[i] : bounds[i + 1]]] = 0
    return out


def meeting(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose row key is among ``keys``, and few others: one bit per remainder of a hash of the keys."""
    place = F.pmod(F.xxhash64(*ROW_KEY), F.lit(FILTER_BITS))
    # FILTER_BITS / 64 rows at most
    bits = keys.select(place.alias("place")).distinct().groupBy(F.expr("place div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    held = texts.withColumn("_place", place).join(F.broadcast(bits), F.expr("_place div 64 = word"))
    return held.where("shiftright(bits, cast(_place % 64 as int)) & 1 = 1").select(*texts.columns)


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float, plain: bool) -> DataFrame:
    """Links (a, b) that connect the same classes as all pairs at ``similarity`` inside the clusters of ``pairs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words)
        for block, _ in runs(batches, 1 << 62):
            key, node, side = (block[c].to_numpy() for c in ("key", "node", "side"))
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1)).tolist()
            links = []
            for low, high in zip(starts, [*starts[1:], len(key)], strict=True):
                rows = block.iloc[low:high]
                wide = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint64).reshape(high - low, -1)
                sides = side[low:high] if side[low] >= 0 else None
                found = exact_forest(wide, list(shingles.sets(rows["text"].tolist())), sides, similarity)
                links += [(node[low + i], node[low + k]) for i, k in found]
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    clusters = materialize(components(pairs, "a", "b"), "clusters")
    sizes = nodes.select("node", "n").join(clusters, "node").groupBy("root").agg(
        F.ceil(F.greatest(F.count("*") / CLUSTER_TEXTS, F.sum("n") / CLUSTER_SHINGLES)).alias("tiles")
    )
    part, other, tiles = F.col("part"), F.col("other"), F.coalesce("tiles", F.lit(1))
    inside = nodes.join(clusters, "node")
    members = (
        inside.join(materialize(sizes.where("tiles > 1"), "tiles"), "root", "left")
        .withColumn("part", F.pmod(F.xxhash64("node"), tiles))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)))
        .withColumn("key", F.xxhash64("root", F.least(part, other), F.greatest(part, other)))
        # a tile on its own compares all its pairs, two tiles compare the pairs across
        .withColumn("side", F.when(part == other, -1).otherwise((part > other).cast("int")))
        .select("key", "side", "node", "sketch", *ROW_KEY)
    )
    held = members.join(meeting(texts.select(*ROW_KEY, "text"), inside), ROW_KEY).select("key", "side", "node", "sketch", "text")
    if not plain:
        held = held.dropDuplicates(["key", "node"])
    n = parallelism(nodes.sparkSession)
    return held.repartition(n, "key").sortWithinPartitions("key").mapInPandas(run, "a bigint, b bigint")


def near_groups(keyed: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, plain: bool = False) -> DataFrame:
    """Row key and ``group``: rows with equal or similar texts have the same group.

    ``plain`` says that no two rows have the same key.
    """
    texts = keyed.select(*ROW_KEY, "text")
    rows = materialize(sketches(texts, words), "sketches")
    nodes = materialize(rows.dropDuplicates(["node"]), "classes")
    # texts without a word are equal to each other and to nothing else
    links = verified(candidates(nodes.where("n > 0")), nodes, texts, words, similarity, plain)
    roots = materialize(components(links, "a", "b"), "roots")
    labelled = rows.select(*ROW_KEY, "node").join(roots, "node", "left")
    return labelled.select(*ROW_KEY, F.coalesce("root", "node").alias("group"))


def without_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of every group stays, the one with the smallest doc_id, with the columns of ``docs``.

    NULL and blank texts are one group.  Of repeated rows one stays; rows without doc_id stay if
    their group has no other; no rows give none.
    """
    plain = ids_are_keys(docs)
    full = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.col("text").cast("string").alias("text"))
    keyed = with_row_key(full, plain)
    first = F.min(F.struct(F.col("_tag").bitwiseAND(F.lit(1)).alias("no_id"), *ROW_KEY)).alias("first")
    kept = near_groups(keyed, words, similarity, plain).groupBy("group").agg(first).select(*[f"first.{c}" for c in ROW_KEY])
    stay = keyed.join(materialize(kept, "kept"), ROW_KEY, "left_semi").select(*ROW_KEY, "doc")
    if not plain:
        stay = stay.dropDuplicates(ROW_KEY)
    return stay.select("doc.*")
