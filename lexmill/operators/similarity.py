"""Set-similarity join over whole tables: all pairs of texts whose token sets overlap enough.

Equal token sets are one class, so copies are counted instead of paired.  The tokens of a set are ordered by rising
frequency; two sets that reach a Jaccard similarity of t share a token among the first n - ceil(t n) + 1 of each.  Only
these prefixes meet, dealt over parts by token.  Lengths, places and a bitmap of the whole set bound what a pair can
share; the pairs that are left are counted token by token.  No token set travels with a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from ..sources.tables import materialize

#: Texts that one token meets in; more frequent tokens are cut into cells that meet pairwise.
PART_ROWS = 8_192
#: Parts that tokens are dealt over at least, and texts per part; the texts of a batch, and the pairs and the words
#: of bitmaps that a task looks at at a time.
PARTS, PART_TEXTS = 12, 1 << 15
BATCH_TEXTS, BLOCK_PAIRS, BLOCK_WORDS = 1_000, 1 << 18, 1 << 19
#: Pairs that are counted at a time in a part; beyond them its tokens are copied.
PART_PAIRS = 1 << 24
#: Counters of token frequencies, and of the sets that some pair is left for; they are all that passes the driver.
COUNTERS, MARKS, CHUNK = 1 << 22, 1 << 22, 1 << 16
EPSILON = 1e-9
#: Hashes recur, so a dictionary that holds all of a file's makes two or three bytes of each.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


def token_sets(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, ``set_id`` (128 bits of hash tell sets apart), ``no`` and ``toks``.

    Tokens are the distinct ones as 64-bit hashes; so is ``no``, by which sets are known while pairs are sought.
    NULL tokens count as none.
    """
    words = F.sort_array(F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>"))))
    sets = docs.select(F.col(key), words.alias("words"))
    digest = F.md5(F.concat_ws("\x1f", F.size("words").cast("string"), "words"))
    hashes = F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))
    rows = sets.select(key, F.unhex(digest).alias("set_id"), F.xxhash64(digest).alias("no"), hashes.alias("toks"))
    return materialize(rows, "sets", **PACKED)


def set_classes(rows: DataFrame, key: str) -> DataFrame:
    """One row per distinct set: set_id, no, n (its tokens), class_id (its smallest key) and members."""
    some = [F.any_value(c).alias(name) for c, name in ((F.col("no"), "no"), (F.size("toks"), "n"))]
    return materialize(rows.groupBy("set_id").agg(*some, F.min(key).alias("class_id"), F.count("*").alias("members")), "classes")


def counters(hashes: DataFrame, size: int) -> np.ndarray:
    """How often the arrays of the only column hold a hash of each remainder; ``size`` numbers, whatever the input."""
    chunk = min(size, CHUNK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, "int64")
        for batch in batches:
            held = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False)
            total += np.bincount(held & (size - 1), minlength=size)
        total = np.minimum(total, np.iinfo("int32").max).astype("int32").reshape(-1, chunk)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("int32")), pa.array([total[c].tobytes() for c in used], pa.binary())], ["chunk", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(chunk, "int64")
        for one in table["counts"]:
            total += np.frombuffer(one.as_py(), "int32")
        total = np.minimum(total, np.iinfo("int32").max).astype("int32")
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk INT, counts BINARY"
    out = np.zeros((size // chunk, chunk), "int32")
    for r in hashes.mapInArrow(count, schema).groupBy("chunk").applyInArrow(add, schema).collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], "int32")
    return out.reshape(-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _lists(heads: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.array(values, kind))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(no, n, the set of each token, tokens) of a bounded number of sets that have tokens."""
    for batch in batches:
        for at in range(0, len(batch), BATCH_TEXTS):
            part = batch.slice(at, BATCH_TEXTS)
            part = part.filter(pc.greater(pc.list_value_length(part["toks"]), 0))
            if len(part):
                n = pc.list_value_length(part["toks"]).to_numpy().astype("int64")
                yield part["no"].to_numpy(), n, np.repeat(np.arange(len(n)), n), pc.list_flatten(part["toks"]).to_numpy().astype("int64")


def bitmaps(n: np.ndarray, own: np.ndarray, toks: np.ndarray) -> pa.Array:
    """A bitmap per set, of two to four bits a token: a bit is the parity of the tokens that fall on it.

    Two sets differ in at least as many tokens as their bitmaps differ in bits.  The halves of a bitmap, added
    without carry, are the bitmap of half the width.
    """
    width = np.maximum(64, 1 << np.ceil(np.log2(2 * n)).astype("int64"))
    ends = np.cumsum(width // 64)
    bit = _mixed(toks.view("uint64") ^ np.uint64(0x5851F42D4C957F2D)).astype("int64") & (width[own] - 1)
    words = np.zeros(ends[-1], "uint64")
    np.bitwise_xor.at(words, (ends - width // 64)[own] + (bit >> 6), np.uint64(1) << (bit & 63).astype("uint64"))
    offsets = np.concatenate([[0], ends * 8]).astype("int32")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(words)])


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - EPSILON).astype("int64") + 1


def dealt_prefixes(counts: np.ndarray, t: float, parts: int, part_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per set and part that has tokens of its prefix: part, no, n, bitmap, the tokens and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, n, own, toks in _batches(batches):
            often = counts[toks & (COUNTERS - 1)]
            order = np.lexsort((toks, often, own))
            own, toks, often = own[order], toks[order], often[order]
            place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + 1
            bits = bitmaps(n, own, toks)
            # a token that is counted once is in no other set
            kept = (place <= prefix_length(n, t)[own]) & (often > 1)
            own, toks, often, place = own[kept], toks[kept].view("uint64"), often[kept].astype("int64"), place[kept]
            cells = -(-often // part_rows)
            mine = (_mixed(no.view("uint64"))[own] % cells.astype("uint64")).astype("int64")
            # a set meets, under a name of their own, each pair of cells of which one is its own
            other = _ranges(np.zeros(len(cells), "int64"), cells)
            own, toks, place, cells, mine = (np.repeat(x, cells) for x in (own, toks, place, cells, mine))
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            name = _mixed(toks + _mixed((low * cells + high).astype("uint64")))
            part = (name % np.uint64(parts)).astype("int64")
            order = np.lexsort((part, own))
            own, part, name, place = own[order], part[order], name[order], place[order]
            heads = np.flatnonzero(np.diff(own * parts + part, prepend=-1))
            at, ends = own[heads], np.append(heads, len(own))
            yield pa.RecordBatch.from_arrays([
                pa.array(part[heads].astype("int32")), pa.array(no[at]), pa.array(n[at].astype("int32")), bits.take(pa.array(at)),
                _lists(ends, (name >> np.uint64(32)).astype("uint32").view("int32"), pa.int32()),
                # a place that is too large is taken for a smaller one, which leaves more possible
                _lists(ends, np.minimum(place, 32_767).astype("int16"), pa.int16()),
            ], ["part", "no", "n", "bits", "names", "places"])

    return run


class _Bitmaps:
    """Bitmaps of a part by width; each width also holds the wider ones, folded."""

    def __init__(self, bits: pa.Array):
        _, ends, data = bits.buffers()
        ends = np.frombuffer(ends, "int32")[bits.offset : bits.offset + len(bits) + 1] // 8
        flat, size = np.frombuffer(data, "uint64", count=int(ends[-1])), np.diff(ends)
        self.size, self.rows, self.at = size, {}, {}
        wider, held = np.zeros(0, "int64"), np.zeros((0, 0), "uint64")
        for words in sorted({1 << k for k in range(int(size.max()).bit_length())}, reverse=True):
            if held.shape[1] > words:
                held = held[:, :words] ^ held[:, words:]
            new = np.flatnonzero(size == words)
            fresh = flat[ends[new][:, None] + np.arange(words, dtype="int32")]
            held = np.concatenate([held.reshape(-1, words), fresh])
            wider = np.concatenate([wider, new])
            if len(new):
                at = np.full(len(size), -1, "int32")
                at[wider] = np.arange(len(wider))
                self.rows[words], self.at[words] = held, at

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the sets i differ from the sets j, at the width of i, the narrower."""
        out = np.zeros(len(i), "int64")
        size = self.size[i]
        for words in np.unique(size).tolist():
            rows, at, step = self.rows[words], self.at[words], max(1, BLOCK_WORDS // words)
            here = np.flatnonzero(size == words)
            for s in range(0, len(here), step):
                h = here[s : s + step]
                out[h] = np.bitwise_count(rows[at[i[h]]] ^ rows[at[j[h]]]).sum(axis=1, dtype="int64")
        return out


def pairs_of_part(t: float) -> Callable[[pa.Table], pa.Table]:
    """The sets b, of larger number, with which a set a shares a token of this part and may reach ``t``."""

    def run(table: pa.Table) -> pa.Table:
        # copies of a text bring the same row
        no = table["no"].to_numpy()
        only = np.zeros(len(no), bool)
        only[np.unique(no, return_index=True)[1]] = True
        n = table["n"].to_numpy().astype("int64")
        maps = _Bitmaps(table["bits"].combine_chunks())
        row = np.repeat(np.arange(len(n), dtype="int32"), pc.list_value_length(table["names"]).to_numpy())
        kept = np.flatnonzero(only[row])
        name, place, row = pc.list_flatten(table["names"]).to_numpy()[kept], pc.list_flatten(table["places"]).to_numpy()[kept], row[kept]
        order = np.lexsort((row, n[row], name))
        name, place, row = name[order], place[order], row[order]
        del kept, order
        # under a name, smaller sets come first, and those that are not too small are the ones just before
        group = np.cumsum(np.diff(name, prepend=name[:1]) != 0) * (n.max() + 2)
        least = np.searchsorted(group + n[row], group + np.ceil(t * n[row] - EPSILON).astype("int64"), "left")
        upto = np.cumsum(np.arange(len(row)) - least)
        del group, name
        found, fresh, at = [np.zeros(0, "int64")], 0, 0
        while at < len(row):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
            here = np.arange(at, end)
            x, y = _ranges(least[at:end], here), np.repeat(here, here - least[at:end])
            at = end
            i, j = row[x], row[y]
            need = np.ceil(t / (1 + t) * (n[i] + n[j]) - EPSILON)
            # true for the first token a pair shares, if the pair reaches t
            left = 1 + np.minimum(n[i] - place[x], n[j] - place[y])
            still = np.flatnonzero((left >= need) & (i != j))
            i, j, need = i[still], j[still], need[still]
            still = (n[i] + n[j] - maps.differing(i, j)) // 2 >= need
            i, j = i[still], j[still]
            found.append(np.unique(np.minimum(i, j).astype("int64") * len(n) + np.maximum(i, j)))
            fresh += len(i)
            # near copies meet on many tokens: their pairs are held once
            if fresh > max(len(found[0]), 4 * BLOCK_PAIRS):
                found, fresh = [np.unique(np.concatenate(found))], 0
        i, j = np.divmod(np.unique(np.concatenate(found)), len(n))
        a, b = np.minimum(no[i], no[j]), np.maximum(no[i], no[j])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, "int64")
        return pa.table({"a": a[heads], "b": _lists(np.append(heads, len(a)), b, pa.int64())})

    return run


def dealt_tokens(marks: np.ndarray, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per marked set and part: all its tokens there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, _, own, toks in _batches(batches):
            kept = marks[no & (MARKS - 1)][own]
            own, toks = own[kept], toks[kept]
            part = (_mixed(toks.view("uint64")) % np.uint64(parts)).astype("int64")
            order = np.lexsort((part, own))
            own, part, toks = own[order], part[order], toks[order]
            heads = np.flatnonzero(np.diff(own * parts + part, prepend=-1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[heads].astype("int32")), pa.array(no[own[heads]]), _lists(np.append(heads, len(own)), toks, pa.int64())],
                ["part", "no", "toks"])

    return run


def shared_of_part(sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """How many tokens of this part a set shares with each of its b, in their order."""
    schema = pa.schema([("a", pa.int64()), ("shared", pa.list_(pa.int32()))])
    if not sets.num_rows or not pairs.num_rows:
        return schema.empty_table()
    # copies of a text bring the same row
    no, first = np.unique(sets["no"].to_numpy(), return_index=True)
    sets = sets.select(["toks"]).take(pa.array(first))
    held = pc.list_value_length(sets["toks"]).to_numpy().astype("int64")
    ends = np.cumsum(held)
    toks = pc.list_flatten(sets["toks"]).to_numpy()
    known = np.unique(toks)
    ranks = len(known)
    keys = np.repeat(np.arange(len(held)), held) * ranks + np.searchsorted(known, toks)
    del known, toks
    keys.sort()
    rank = (keys % ranks).astype("int32")
    out = []
    many = np.cumsum(pc.list_value_length(pairs["b"]).to_numpy())
    at = 0
    while at < len(many):
        upto = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
        some = pairs.slice(at, upto - at)
        at = upto
        sizes = pc.list_value_length(some["b"]).to_numpy()
        a, b = np.repeat(some["a"].to_numpy(), sizes), pc.list_flatten(some["b"]).to_numpy()
        i, j = (np.minimum(np.searchsorted(no, x), len(no) - 1) for x in (a, b))
        # a set without a token in this part has no row here
        both = np.flatnonzero((no[i] == a) & (no[j] == b))
        i, j = i[both], j[both]
        shared, work, start = np.zeros(len(a), "int32"), np.cumsum(held[i]), 0
        while start < len(i):
            stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + BLOCK_PAIRS, "right")))
            x, y = i[start:stop], j[start:stop]
            wanted = np.repeat(y, held[x]) * ranks + rank[_ranges(ends[x] - held[x], ends[x])]
            hit = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
            shared[both[start:stop]] = np.bincount(np.repeat(np.arange(len(x)), held[x]), hit, len(x))
            start = stop
        out.append(pa.table([some["a"], _lists(np.append(0, np.cumsum(sizes)), shared, pa.int32())], schema=schema))
    return pa.concat_tables(out)


def shared_tokens(sets: DataFrame, texts: int, t: float, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b, shared): how many tokens two sets share, for all pairs that may reach ``t``."""
    parts = max(PARTS, -(-texts // PART_TEXTS))
    # any order that all sets agree on will do
    counts = counters(sets.select("toks"), COUNTERS)
    columns = "part INT, no BIGINT, n INT, bits BINARY, names ARRAY<INT>, places ARRAY<SMALLINT>"
    prefixes = sets.select("no", "toks").mapInArrow(dealt_prefixes(counts, t, parts, part_rows), columns)
    lists = prefixes.groupBy("part").applyInArrow(pairs_of_part(t), "a BIGINT, b ARRAY<BIGINT>")
    pairs = materialize(lists.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("b"))).alias("b")), "pairs")
    marks = counters(pairs.select(F.concat(F.array("a"), "b").alias("no")), MARKS) > 0
    tokens = sets.select("no", "toks").mapInArrow(dealt_tokens(marks, parts), "part INT, no BIGINT, toks ARRAY<BIGINT>")
    found = pairs.agg(F.coalesce(F.sum(F.size("b")), F.lit(0))).first()[0]
    slices = max(1, -(-found // PART_PAIRS))
    tokens = tokens.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asked = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("a"), F.lit(slices)).cast("int").alias("slice"))
    shared = tokens.groupBy("part", "slice").cogroup(asked.groupBy("part", "slice")).applyInArrow(shared_of_part, "a BIGINT, shared ARRAY<INT>")
    # a list of counts from each part
    lists = shared.groupBy("a").agg(F.collect_list("shared").alias("s"))
    total = F.reduce(F.slice("s", 2, parts), F.element_at("s", 1), lambda x, y: F.zip_with(x, y, lambda p, q: p + q))
    met = pairs.join(lists.select("a", total.alias("shared")), "a")
    return met.select("a", F.explode(F.arrays_zip("b", "shared")).alias("p")).select("a", "p.b", "p.shared")


def similar_sets(sets: DataFrame, ids: DataFrame, texts: int, t: float, part_rows: int = PART_ROWS) -> DataFrame:
    """Pairs of sets (a, b) with their classes and their exact Jaccard similarity, all that reach ``t``."""
    named = ids.select("no", "class_id", "n")
    met = shared_tokens(sets, texts, t, part_rows).join(named.toDF("a", "class_x", "n"), "a").join(named.toDF("b", "class_y", "m"), "b")
    jaccard = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    return met.select("a", "b", "class_x", "class_y", jaccard.alias("jaccard")).where(F.col("jaccard") >= t - EPSILON)


def similarity_classes(docs: DataFrame, key: str, tokens: Column, t: float, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(pairs, members).

    pairs: class_a < class_b and jaccard, for all different token sets that reach ``t``; members: one row per
    row of ``docs`` with its class, the class's number of members, its number of links, and its best link.
    Texts without tokens are a class without links.
    """
    rows = token_sets(docs, key, tokens)
    ids = set_classes(rows, key)
    found = materialize(similar_sets(rows, ids, rows.count(), t, part_rows), "similar")
    pairs = found.select(F.least("class_x", "class_y").alias("class_a"), F.greatest("class_x", "class_y").alias("class_b"), "jaccard")
    ends = found.select(F.col("a").alias("no"), "jaccard").union(found.select("b", "jaccard"))
    links = ends.groupBy("no").agg(F.count("*").alias("links"), F.max("jaccard").alias("best_jaccard"))
    per_class = materialize(ids.join(links, "no", "left").drop("no", "n"), "links")
    members = salted_join(rows.select(key, "set_id"), per_class, ["set_id"], key).select(
        key, "class_id", "members", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), "best_jaccard"
    )
    return pairs, members
