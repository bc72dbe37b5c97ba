"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is cut into bytes.  Two fingerprints that differ in at most ``max_bits`` bits agree
in at least ``8 - max_bits`` of their eight positional bytes, the guaranteed minimum of matches.
The index lists fingerprints under sets of positional bytes chosen so that every pair with the
minimum shares one list.  Within a list the shared bytes of a pair are tallied, pairs below the
minimum are left out, and the rest is verified bit by bit.  A list gives a spanning forest of its
links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, materialize, parallelism, with_row_key
from .components import components
from .words import mix

SEED = 42
POSITIONS = 8
#: Rows of one index list that a task holds at once; longer lists are compared tile by tile.
TILE = 16384

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a shorter text is one shingle, an empty one none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1:].tolist(), strict=False)]
    return np.array(hashes, dtype=np.uint64)


def majority(rows: np.ndarray) -> np.ndarray:
    """Per column of 64-bit words: bits set in over half the rows, counted by carry-save addition."""
    n, width = rows.shape
    counts = np.zeros(width * 64, dtype=np.int64)
    weight, current = 1, rows
    while len(current):
        carries = []
        while len(current) >= 3:
            k = len(current) // 3
            a, b, c = current[:k], current[k : 2 * k], current[2 * k : 3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            current = np.concatenate([half ^ c, current[3 * k :]])
        bits = np.unpackbits(np.ascontiguousarray(current).view(np.uint8), axis=1, bitorder="little")
        counts += weight * bits.sum(axis=0, dtype=np.int64)
        current = np.concatenate(carries) if carries else current[:0]
        weight *= 2
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, width: int, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; the first is the plain SimHash of the shingle hashes."""
    h = shingle_hashes(text, width)
    if not len(h):
        return np.zeros(words, dtype=np.uint64)
    more = [h, *(mix(h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) for k in range(1, words))]
    return majority(np.stack(more, axis=1))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and its 64-bit fingerprint ``fp`` (a long); NULL and blank texts have fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            fp = [fingerprint(t, width)[0] for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "fp": np.array(fp, dtype=np.uint64).view(np.int64)})

    # ids travel as strings: pandas has no long with NULLs
    picked = docs.select(
        F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return picked.mapInPandas(run, "doc_id string, fp bigint").withColumn("doc_id", F.col("doc_id").cast("bigint"))


# ---------------------------------------------------------------- the index


def position_sets(matches: int) -> list[tuple[int, ...]]:
    """Sets of ``matches - 1`` byte positions such that any ``matches`` positions hold one of them.

    Turán's construction for four of eight: positions fall into three classes, and a triple is
    taken if it lies in one class or has two in a class and one in the next.
    """
    if matches != 4:
        return list(combinations(range(POSITIONS), matches))
    kind = [0, 0, 0, 1, 1, 1, 2, 2]
    chosen = []
    for triple in combinations(range(POSITIONS), 3):
        count = [sum(kind[p] == k for p in triple) for k in range(3)]
        if 3 in count or any(count[k] == 2 and count[(k + 1) % 3] == 1 for k in range(3)):
            chosen.append(triple)
    return chosen


def index_lists(fps: DataFrame, matches: int) -> DataFrame:
    """One row per fingerprint and position set: the list's key and the fingerprint."""

    def byte(p: int):
        return F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255).cast("bigint"))

    keys = []
    for number, positions in enumerate(position_sets(matches)):
        key = F.lit(number).cast("bigint")
        for p in positions:
            key = key * 256 + byte(p)
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def runs(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Runs of equal ``key`` in sorted batches as blocks of whole runs, split above ``limit`` rows.

    The flag says that the block belongs to a run longer than ``limit``.
    """
    held, long_key = None, None
    for part in batches:
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        keys = held["key"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
        if cut:
            yield held.iloc[:cut], False
            held = held.iloc[cut:].reset_index(drop=True)
        while len(held) > limit:
            long_key = held["key"].iloc[0]
            yield held.iloc[:limit], True
            held = held.iloc[limit:].reset_index(drop=True)
    if held is not None and len(held):
        yield held, long_key is not None and held["key"].iloc[0] == long_key


def agreeing_bytes(x: np.ndarray) -> np.ndarray:
    """How many bytes of each XOR are zero."""
    return (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)


def near(a: np.ndarray, b: np.ndarray, max_bits: int, matches: int) -> np.ndarray:
    """The count filter, then the exact test."""
    x = np.ascontiguousarray(a ^ b)
    keep = agreeing_bytes(x) >= matches
    keep[keep] = np.bitwise_count(x[keep]) <= max_bits
    return keep


def forest(fp: np.ndarray, max_bits: int, matches: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within one list, breadth first."""
    out, rest = [], fp
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            f = frontier.pop()
            hit = near(rest, f, max_bits, matches)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                out.append((np.full(len(found), f, dtype=np.uint64), found))
                frontier.extend(found)
    return out


SHORT = 24


def list_links(block: pd.DataFrame, max_bits: int, matches: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links in a block of sorted lists: short lists all at once, long ones one by one."""
    key, fp = block["key"].to_numpy(), block["fp"].to_numpy().view(np.uint64)
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    sizes = np.diff(np.append(starts, len(key)))
    size_of = np.repeat(sizes, sizes)
    out = []
    k, f = key[size_of <= SHORT], fp[size_of <= SHORT]
    for step in range(1, min(SHORT, int(sizes.max(initial=1)))):
        at = np.flatnonzero(k[step:] == k[:-step])
        if not len(at):
            break
        hit = at[near(f[at], f[at + step], max_bits, matches)]
        out.append((f[hit], f[hit + step]))
    for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
        out.extend(forest(fp[s : s + n], max_bits, matches))
    return out


def as_pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    left = np.concatenate([a for a, _ in found]) if found else np.zeros(0, dtype=np.uint64)
    right = np.concatenate([b for _, b in found]) if found else np.zeros(0, dtype=np.uint64)
    return pd.DataFrame({"a": left.view(np.int64), "b": right.view(np.int64)})


def links(fps: DataFrame, max_bits: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``max_bits``; fps must be distinct."""
    matches = POSITIONS - max_bits
    if matches < 1:
        raise ValueError("the index guarantees a shared byte for at most 7 differing bits")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, part_of_long in runs(batches, tile):
            yield as_pairs(list_links(block, max_bits, matches)).assign(long_key=None)
            if part_of_long:
                yield pd.DataFrame({"a": [None], "b": [None], "long_key": [int(block["key"].iloc[0])]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, _ in runs(batches, 1 << 62):
            yield as_pairs(list_links(block, max_bits, matches))

    spark = fps.sparkSession
    lists = index_lists(fps, matches)
    found = materialize(
        lists.repartition(parallelism(spark), "key")
        .sortWithinPartitions("key")
        .mapInPandas(scan, "a bigint, b bigint, long_key bigint"),
        "links",
    )
    pairs = found.where("long_key is null").select("a", "b")
    long_keys = found.where("long_key is not null").groupBy("long_key").agg(F.count("*").alias("tiles"))
    if not long_keys.isEmpty():
        # a list above the tile size: every two tiles of it meet in one task
        parts = (
            lists.join(long_keys, lists["key"] == long_keys["long_key"])
            .withColumn("part", F.pmod(F.xxhash64("fp"), 2 * F.col("tiles")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), 2 * F.col("tiles") - 1)))
            .select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "fp")
        )
        more = parts.repartition(parallelism(spark), "key").sortWithinPartitions("key").mapInPandas(
            whole, "a bigint, b bigint"
        )
        pairs = pairs.union(more)
    return pairs


def simhash_groups(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of ``max_bits`` bits.

    NULL and blank texts have fingerprint 0 and are linked like others; equal rows stay, each
    with its component; a component without any doc_id has a NULL component_id; no rows give
    none.  Columns other than doc_id and text are not read.
    """
    fps = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits), "a", "b")
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    least = labelled.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    # one row per fingerprint; written, so that the join to the documents can split a hot fingerprint
    known = materialize(labelled.join(least, "root").select("fp", "component_id"), "groups")
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
