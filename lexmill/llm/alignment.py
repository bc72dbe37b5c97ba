"""Alignment of two tokenizers as a product of fragments of an associative monoid.

A fragment describes a range of bytes: the tokens before the first place where both tokenizers end one
(open prefix), the groups between such places (closed groups), and the tokens after the last one (open
suffix).  Composing two fragments closes the suffix of the left with the prefix of the right; a range without a
common end is all prefix.  The operation is associative, so fragments of a very long text are made in
different tasks and composed level by level, some at a time.

Texts are cut at single spaces between ASCII marks or letters.  Neither tokenizer has a token that goes
on over such a space (``Pair`` checks that), so each part is tokenized like a text of its own, and the fragment of a
part that occurs again is looked up.  Counts of id pairs are joined back through blocks of texts: a block
holds its distinct pairs once, so what is shuffled is a row per block and pair instead of one per text and pair.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parallelism

TOKENIZERS = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a text that one task tokenizes at a time, and of a fragment of a longer one.
PIECE_BYTES, FRAGMENT_BYTES, FANIN = 32_768, 8_192, 8
#: Pairs of texts in a block, texts in a block, and parts whose fragments a task remembers.
BLOCK_PAIRS, BLOCK_TEXTS, REMEMBERED = 1_000_000, 20_000, 300_000
SLICE_CHARS, RUN_PARTS = 2_000_000, 5_000
#: Pairs of a group that are listed before they are counted; larger groups are counted by distinct ids.
LARGE_GROUP = 100_000
SIGNS = np.array([",", "|", ";", "\n"], dtype=object)

SAFE = re.compile(r"(?<=[!-~]) (?=[!-~])")

DOC = "doc_id bigint, ok boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
BLOCKED = f"block bigint, pairs array<bigint>, docs array<int>, {DOC}, codes binary, mult binary"
FRAGMENT = (
    "uid bigint, doc_id bigint, at bigint, ok boolean, cut boolean, n_a bigint, n_b bigint, n_groups bigint, "
    "n_links bigint, groups string, pairs binary, mult binary, pre_a binary, pre_b binary, post_a binary, post_b binary"
)


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=kind)


@dataclass
class Fragment:
    """Tallies and text of the closed groups, and the open tokens on both sides.

    Without a common end inside (``cut``) all tokens are in the prefix.
    """

    cut: bool = False
    pre: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    post: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    groups: list[str] = field(default_factory=list)
    links: Counter = field(default_factory=Counter)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    ok: bool = True

    def close(self, a: list[int], b: list[int]) -> None:
        if not a and not b:
            return
        self.groups.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        self.n_a, self.n_b, self.n_groups = self.n_a + len(a), self.n_b + len(b), self.n_groups + 1
        if len(a) == len(b) == 1:
            self.links[a[0] << 32 | b[0]] += 1
            return
        right = Counter(b).items()
        for x, m in Counter(a).items():
            for y, k in right:
                self.links[x << 32 | y] += m * k

    def __add__(self, other: Fragment) -> Fragment:
        out = Fragment(ok=self.ok and other.ok, cut=self.cut or other.cut)
        if not self.cut:
            joined = (self.pre[0] + other.pre[0], self.pre[1] + other.pre[1])
            out.pre, out.post = joined, other.post
        elif not other.cut:
            out.pre, out.post = self.pre, (self.post[0] + other.pre[0], self.post[1] + other.pre[1])
        else:
            out.pre, out.post = self.pre, other.post
        for part, after in ((self, other.cut), (other, False)):
            out.groups += part.groups
            out.links.update(part.links)
            out.n_a, out.n_b, out.n_groups = out.n_a + part.n_a, out.n_b + part.n_b, out.n_groups + part.n_groups
            if after and self.cut:
                out.close(self.post[0] + other.pre[0], self.post[1] + other.pre[1])
        return out

    def finished(self) -> Fragment:
        """The fragment of a whole text: its start and its end are common ends."""
        out = Fragment(cut=True, ok=self.ok)
        out.close(*self.pre)
        out.groups += self.groups
        out.links.update(self.links)
        out.n_a, out.n_b, out.n_groups = out.n_a + self.n_a, out.n_b + self.n_b, out.n_groups + self.n_groups
        out.close(*self.post)
        return out


def fragment(a: Iterable[tuple[int, int]], b: Iterable[tuple[int, int]]) -> Fragment:
    """Fragment of the (id, end) tokens of a byte range; a common end closes what lies before it."""
    out, held_a, held_b = Fragment(), [], []
    right = iter(b)
    y = next(right, None)
    for token, end in a:
        while y is not None and y[1] < end:
            held_b.append(y[0])
            y = next(right, None)
        held_a.append(token)
        if y is not None and y[1] == end:
            held_b.append(y[0])
            y = next(right, None)
            if out.cut:
                out.close(held_a, held_b)
            else:
                out.cut, out.pre = True, (held_a, held_b)
            held_a, held_b = [], []
    while y is not None:
        held_b.append(y[0])
        y = next(right, None)
    if out.cut:
        out.post = (held_a, held_b)
    else:
        out.pre = (held_a, held_b)
    return out


class Pair:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, folder: str, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        path = f"{folder}/{first}"
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{second}")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        back = _byte_letters()
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
            for p in pieces
        ]
        self.length_a, self.length_b = (np.array([len(x) for x in known], dtype=np.int64) for known in (self.bytes_a, self.bytes_b))
        self.decimal = np.array([str(i) for i in range(max(len(self.bytes_a), len(pieces)))], dtype=object)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        #: Whether a single space between ASCII marks always starts a token of both.
        self.separable = bool(
            plain and spec.get("normalizer") is None and not any(re.search("[^▁]▁", p) for p in pieces)
        )

    def tokens(self, parts: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Ids of both for each part, which stands behind a space, and whether both give back its bytes."""
        first = self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)
        second = self.b.encode(parts, num_threads=1)
        for part, x, b in zip(parts, first, second, strict=True):
            a, raw = x.ids, (" " + part).encode("utf-8", "surrogatepass")
            same = b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw
            yield a, b, same

    def flat_tokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts one after the other, the numbers per part, and which parts both give back; others have none.

        Parts that begin and end with an ASCII mark or letter are joined by spaces, at which both tokenizers
        begin anew, and tokenized in long runs; the ids are dealt to the parts by their ends.
        """
        joined = [i for i, p in enumerate(parts) if self.separable and p and "!" <= p[0] <= "~" and "!" <= p[-1] <= "~"]
        raw = [(" " + p).encode("utf-8", "surrogatepass") for p in parts]
        length = np.array([len(r) for r in raw], dtype=np.int64)
        ids: list[list[np.ndarray]] = [[], []]
        size = [np.zeros(len(parts), dtype=np.int64) for _ in range(2)]
        ok = np.zeros(len(parts), dtype=bool)
        runs = [joined[at : at + RUN_PARTS] for at in range(0, len(joined), RUN_PARTS)]
        order: list[int] = []
        for run in runs:
            ((a, b, same),) = self.tokens([" ".join([parts[i] for i in run])])
            if not same:
                # one part spoils the run: its parts are looked at one by one
                joined = [i for i in joined if i not in set(run)]
                continue
            borders = np.cumsum(length[run])
            for k, (flat, lengths) in enumerate(((np.array(a, np.int64), self.length_a), (np.array(b, np.int64), self.length_b))):
                upto = np.searchsorted(np.cumsum(lengths[flat]), borders, side="right")
                size[k][run] = np.diff(upto, prepend=0)
                ids[k].append(flat)
            ok[run] = True
            order += run
        single = sorted(set(range(len(parts))).difference(joined))
        for i, (a, b, same) in zip(single, self.tokens([parts[i] for i in single]), strict=True):
            if same:
                ok[i], size[0][i], size[1][i] = True, len(a), len(b)
                ids[0].append(np.array(a, np.int64))
                ids[1].append(np.array(b, np.int64))
                order.append(i)
        place = np.array(order, dtype=np.int64)
        flat = [np.concatenate([np.zeros(0, np.int64), *ids[k]]) for k in range(2)]
        # back into the order of the parts
        for k in range(2):
            start = np.zeros(len(parts), dtype=np.int64)
            start[place] = _offsets(size[k][place])[:-1]
            at = np.repeat(start - _offsets(size[k])[:-1], size[k]) + np.arange(len(flat[k]))
            flat[k] = flat[k][at]
        return flat[0], flat[1], size[0], size[1], ok

    def ends(self, a: list[int], b: list[int], start: int = 0) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        out = []
        for ids, known in ((a, self.bytes_a), (b, self.bytes_b)):
            ends = np.cumsum([len(known[i]) for i in ids]) + start
            out.append(list(zip(ids, ends.tolist(), strict=True)))
        return out[0], out[1]

    def parts(self, text: str) -> list[str]:
        return SAFE.split(text) if self.separable else [text]


@lru_cache(maxsize=2)
def load(folder: str, first: str, second: str) -> Pair:
    """The pair of a Python worker, which serves many tasks."""
    return Pair(folder, first, second)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Closed:
    """Finished fragments of many parts in flat arrays: per part its numbers, groups and links (a pair may repeat)."""

    groups: list[str]
    counts: np.ndarray  # n_a, n_b, n_groups, ok
    sizes: np.ndarray  # links held in pairs and mult
    pairs: np.ndarray
    mult: np.ndarray


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _products(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) for all pairs inside groups; groups with very many are counted by distinct ids."""
    start_a, start_b = _offsets(na)[:-1], _offsets(nb)[:-1]
    few = na * nb <= LARGE_GROUP
    each = np.repeat(few, na)
    group = np.repeat(np.arange(len(na)), na)[each]
    times = nb[group]
    group = np.repeat(group, times)
    left = np.repeat(a[each], times)
    inside = np.arange(len(group)) - np.repeat(_offsets(times)[:-1], times)
    out = [(group, left << 32 | b[start_b[group] + inside], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(~few).tolist():
        x, n = np.unique(a[start_a[g] : start_a[g] + na[g]], return_counts=True)
        y, m = np.unique(b[start_b[g] : start_b[g] + nb[g]], return_counts=True)
        pairs = (x[:, None] << 32 | y).ravel()
        out.append((np.full(len(pairs), g), pairs, np.outer(n, m).ravel()))
    group, pairs, times = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(group, kind="stable")
    return group[order], pairs[order], times[order]


def _group_texts(pair: Pair, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, part_of_group: np.ndarray) -> list[str]:
    """The groups of every part as text: ids of a group in order, those of the first tokenizer before the others."""
    side = np.concatenate([2 * ga, 2 * gb + 1])
    order = np.argsort(side, kind="stable")
    side, ids = side[order], np.concatenate([a, b])[order]
    part, following = part_of_group[side // 2], np.append(side[1:], -2)
    sign = np.where(side == following, 0, np.where(side // 2 == following // 2, 1, 2))
    sign[np.append(part[1:] != part[:-1], True)] = 3
    words = np.empty(2 * len(ids), dtype=object)
    words[::2], words[1::2] = pair.decimal[ids], SIGNS[sign]
    return "".join(words.tolist()).split("\n")[:-1]


def closed_fragments(pair: Pair, parts: list[str]) -> Closed:
    """Every part aligned at once: its borders are common ends, so the fragments of all parts follow one another."""
    a, b, size_a, size_b, ok = pair.flat_tokens(parts)
    n = len(parts)
    counts = np.zeros((n, 4), dtype=np.int64)
    counts[:, 0], counts[:, 1], counts[:, 3] = size_a, size_b, ok
    if not len(a):
        return Closed([""] * n, counts, np.zeros(n, np.int64), a, a)
    end_a, end_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
    common = end_b[end_a[np.minimum(np.searchsorted(end_a, end_b), len(end_a) - 1)] == end_b]
    ga, gb = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    na, nb = np.bincount(ga, minlength=len(common)), np.bincount(gb, minlength=len(common))
    part_of_group = np.repeat(np.arange(n), size_b)[_offsets(nb)[:-1]]
    counts[:, 2] = np.bincount(part_of_group, minlength=n)
    group, pairs, times = _products(a, b, na, nb)
    held = np.flatnonzero(counts[:, 2])
    texts = [""] * n
    for i, t in zip(held.tolist(), _group_texts(pair, a, b, ga, gb, part_of_group), strict=True):
        texts[i] = t
    return Closed(texts, counts, np.bincount(part_of_group[group], minlength=n), pairs, times)


class Parts:
    """Finished fragments of parts by number; it starts anew when it holds too many."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        none = np.zeros(0, dtype=np.int64)
        self.known = Closed([], np.zeros((0, 4), dtype=np.int64), none, none, none)

    def numbers(self, parts: list[str]) -> np.ndarray:
        if len(self.number) > REMEMBERED:
            self.clear()
        new = sorted(set(parts).difference(self.number))
        if new:
            more, old = closed_fragments(self.pair, new), self.known
            self.number.update(zip(new, range(len(old.groups), len(old.groups) + len(new)), strict=True))
            self.known = Closed(old.groups + more.groups, *[
                np.concatenate([getattr(old, c), getattr(more, c)]) for c in ("counts", "sizes", "pairs", "mult")
            ])
        return np.fromiter(map(self.number.__getitem__, parts), dtype=np.int64, count=len(parts))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sum of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(values, first)


@dataclass
class Aligned:
    """One text: its numbers, the hash of its groups, its distinct pairs and how often it links each."""

    doc_id: int | None
    ok: bool
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    sha: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    mult: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))


def slices(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pieces of a batch with a bounded number of characters, one text at least."""
    upto = np.cumsum(part["text"].str.len().fillna(0).to_numpy(dtype=np.int64)) // SLICE_CHARS
    for low, high in zip(np.flatnonzero(np.diff(upto, prepend=-1)), [*np.flatnonzero(np.diff(upto)) + 1, len(part)], strict=False):
        yield part.iloc[low:high]


def aligned_texts(pair: Pair, batches: Iterator[pd.DataFrame]) -> Iterator[Aligned]:
    """Alignment of texts short enough for one task."""
    parts = Parts(pair)
    for batch in batches:
        for part in slices(batch):
            ids = [None if pd.isna(i) else int(i) for i in part["doc_id"]]
            cut = [pair.parts(t) if t else [] for t in part["text"]]
            sizes = np.array([len(c) for c in cut])
            numbers = parts.numbers([p for c in cut for p in c])
            known = parts.known
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(known.counts[numbers], axis=0)])
            total = total[bounds[1:]] - total[bounds[:-1]]
            where = np.concatenate([[0], np.cumsum(known.sizes)])
            for i, doc_id in enumerate(ids):
                n_a, n_b, n_groups, ok = total[i].tolist()
                if not sizes[i] or ok < sizes[i]:
                    yield Aligned(doc_id, ok=False)
                    continue
                mine = numbers[bounds[i] : bounds[i + 1]]
                text = ";".join([known.groups[k] for k in mine.tolist()])
                part_no, times = np.unique(mine, return_counts=True)
                held = known.sizes[part_no]
                start = np.repeat(where[part_no] - np.concatenate([[0], np.cumsum(held)[:-1]]), held)
                at = start + np.arange(len(start))
                pairs, mult = summed(known.pairs[at], known.mult[at] * np.repeat(times, held))
                yield Aligned(doc_id, True, n_a, n_b, n_groups, hashlib.sha256(text.encode()).hexdigest(), pairs, mult)


def blocks(texts: Iterator[Aligned], kind: int) -> Iterator[pd.DataFrame]:
    """Blocks of texts: a row with the distinct pairs and their numbers of texts, then a row per text.

    Block numbers name the task, so they differ between tasks; the rows are written before they are used.
    """
    task = (kind << 60) | (TaskContext.get().partitionId() << 32)
    held: list[Aligned] = []

    def flush(block: int) -> pd.DataFrame:
        sizes = np.array([len(t.pairs) for t in held])
        flat = np.concatenate([t.pairs for t in held])
        pairs, codes, docs = np.unique(flat, return_inverse=True, return_counts=True)
        split = np.split(codes.astype(np.int32), np.cumsum(sizes)[:-1])
        rows = [(block, pairs, docs.astype(np.int32), *[None] * 9)]
        for t, c in zip(held, split, strict=True):
            steps = np.diff(c, prepend=np.int32(0))
            rows.append((
                block, None, None, t.doc_id, t.ok, t.n_a, t.n_b, t.n_groups, int(t.mult.sum()), t.sha,
                packed(steps), packed(t.mult),
            ))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKED.split(", ")])
        return out.astype({c: "Int64" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"ok": "boolean"})

    number, size = 0, 0
    for t in texts:
        if held and (size + len(t.pairs) > BLOCK_PAIRS or len(held) >= BLOCK_TEXTS):
            yield flush(task | number)
            held, number, size = [], number + 1, 0
        held.append(t)
        size += len(t.pairs)
    if held:
        yield flush(task | number)


def pieces(pair: Pair, text: str, size: int) -> Iterator[tuple[int, str]]:
    """(first byte, piece): cut at safe spaces, each piece as long as it takes to reach ``size`` bytes; the space goes with the next."""
    held, length, start = [], 0, 0
    for part in pair.parts(text):
        n = len(part.encode("utf-8", "surrogatepass")) + 1
        if held and length + n > size:
            yield start, " ".join(held)
            held, start, length = [], start + length, 0
        held.append(part)
        length += n
    yield start, " ".join(held)


def composed(fragments: list[Fragment]) -> Fragment:
    """The product of fragments in order, neighbours first, so that nothing is copied more than log2(n) times."""
    while len(fragments) > 1:
        pairs = [x + y for x, y in zip(fragments[::2], fragments[1::2], strict=False)]
        fragments = pairs + fragments[len(pairs) * 2 :]
    return fragments[0]


def piece_fragments(parts: Parts, start: int, text: str, size: int) -> Iterator[tuple[int, Fragment]]:
    """(place, fragment) for each range of ``size`` bytes of the document that the piece has tokens in.

    A token belongs to the range in which it ends, (k * size, (k + 1) * size].  Parts inside a range are closed; a
    part across a border is open on both sides of it.
    """
    cut = parts.pair.parts(text)
    numbers = parts.numbers(cut)
    known = parts.known
    if not known.counts[numbers, 3].all():
        yield start, Fragment(ok=False)
        return
    ends = start + np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in cut])
    low, high = np.append(start, ends[:-1]) // size, (ends - 1) // size
    where = _offsets(known.sizes)
    held: dict[int, list[Fragment]] = {}

    def close(mine: np.ndarray) -> Fragment:
        at = np.concatenate([np.arange(where[k], where[k + 1]) for k in mine.tolist()])
        pairs, mult = summed(known.pairs[at], known.mult[at])
        n_a, n_b, n_groups, _ = known.counts[mine].sum(axis=0).tolist()
        links = Counter(dict(zip(pairs.tolist(), mult.tolist(), strict=True)))
        return Fragment(cut=True, groups=[";".join([known.groups[k] for k in mine.tolist()])], links=links, n_a=n_a, n_b=n_b, n_groups=n_groups)

    inside = low == high
    change = np.flatnonzero(np.diff(np.where(inside, low, -1 - np.arange(len(low))), prepend=-1 - len(low)))
    for i, j in zip(change, [*change[1:], len(low)], strict=True):
        if inside[i]:
            held.setdefault(int(low[i]), []).append(close(numbers[i:j]))
            continue
        ((a, b, _),) = parts.pair.tokens([cut[i]])
        a, b = parts.pair.ends(a, b, int(ends[i - 1]) if i else start)
        split: dict[int, tuple[list, list]] = {}
        for side, tokens in enumerate((a, b)):
            for t in tokens:
                split.setdefault((t[1] - 1) // size, ([], []))[side].append(t)
        for k in sorted(split):
            held.setdefault(k, []).append(fragment(*split[k]))
    for k in sorted(held):
        yield max(start, k * size), composed(held[k])


def to_row(uid: int, doc_id: int | None, at: int, f: Fragment) -> tuple:
    links = sorted(f.links.items())
    keys, values = np.array([k for k, _ in links], np.int64), np.array([v for _, v in links], np.int64)
    sides = [packed(np.array(x, np.int32)) for x in (*f.pre, *f.post)]
    return (uid, doc_id, at, f.ok, f.cut, f.n_a, f.n_b, f.n_groups, int(values.sum()), ";".join(f.groups),
            packed(keys), packed(values), *sides)


def to_fragment(r) -> Fragment:
    sides = [unpacked(x, np.int32).tolist() for x in (r.pre_a, r.pre_b, r.post_a, r.post_b)]
    links = Counter(dict(zip(unpacked(r.pairs, np.int64).tolist(), unpacked(r.mult, np.int64).tolist(), strict=True)))
    return Fragment(r.cut, (sides[0], sides[1]), (sides[2], sides[3]), [r.groups] if r.groups else [], links,
                    r.n_a, r.n_b, r.n_groups, r.ok)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in FRAGMENT.split(", ")])
    return out.astype({"doc_id": "Int64"})


def long_fragments(docs: DataFrame, make: tuple, piece: int, size: int) -> DataFrame:
    """One composed fragment per long text: pieces over all tasks, then a tree of compositions."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, uid = load(*make), TaskContext.get().partitionId() << 32
        for part in batches:
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                rows = [(uid, doc_id, at, p) for at, p in pieces(pair, text, piece)]
                uid += 1
                yield pd.DataFrame(rows, columns=["uid", "doc_id", "at", "text"]).astype({"doc_id": "Int64"})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = Parts(load(*make))
        for part in batches:
            for r in part.itertuples():
                doc_id = None if pd.isna(r.doc_id) else r.doc_id
                yield frame([to_row(r.uid, doc_id, at, f) for at, f in piece_fragments(parts, r.at, r.text, size)])

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        first, whole = rows.iloc[0], composed([to_fragment(r) for r in rows.itertuples()])
        doc_id = None if pd.isna(first["doc_id"]) else int(first["doc_id"])
        return frame([to_row(int(first["uid"]), doc_id, int(first["at"]), whole)])

    n = parallelism(docs.sparkSession)
    # numbers of texts are given by the task, so the pieces are written before they are dealt
    cuts = materialize(docs.mapInPandas(cut, "uid bigint, doc_id bigint, at bigint, text string"), "pieces")
    parts = materialize(cuts.repartition(n, "uid", "at").mapInPandas(build, FRAGMENT), "fragments")
    longest, span = parts.agg(F.max("at")).first()[0] or 0, size
    while span <= longest:
        # neighbours in the text are composed, FANIN ranges at a time
        span *= FANIN
        level = parts.groupBy("uid", F.floor(F.col("at") / span)).applyInPandas(compose, FRAGMENT)
        parts = materialize(level, "tree")
    return parts


def align_tokens(
    docs: DataFrame, folder: str = TOKENIZERS, first: str = FIRST, second: str = SECOND,
    piece: int = PIECE_BYTES, size: int = FRAGMENT_BYTES,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row per input row.

    The count of a pair is the number of rows that link it; repeated rows count each.  NULL and empty
    texts, and texts that a tokenizer does not give back, have no tokens: zeros and ''.  A NULL doc_id
    stays NULL; no rows give none; other columns are not read.
    """
    make = (folder, first, second)
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > piece, F.lit(False))

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from blocks(aligned_texts(load(*make), batches), kind=0)

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[Aligned]:
        for part in batches:
            for r in part.itertuples():
                f, doc_id = to_fragment(r).finished(), None if pd.isna(r.doc_id) else int(r.doc_id)
                if not f.ok:
                    yield Aligned(doc_id, ok=False)
                    continue
                pairs, mult = summed(np.array(list(f.links), np.int64), np.array(list(f.links.values()), np.int64))
                sha = hashlib.sha256(";".join(f.groups).encode()).hexdigest()
                yield Aligned(doc_id, True, f.n_a, f.n_b, f.n_groups, sha, pairs, mult)

    def long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from blocks(finished(batches), kind=1)

    whole = picked.where(~is_long).mapInPandas(short, BLOCKED)
    tree = long_fragments(picked.where(is_long), make, piece, size)
    held = materialize(whole.union(tree.mapInPandas(long, BLOCKED)), "blocks")

    in_block = held.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("code", "p"))
    rows = in_block.select("block", "code", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = materialize(rows.groupBy("pair").agg(F.sum("docs").alias("count")), "counts")
    a_id = F.shiftright("pair", 32).alias("a")
    best = counts.groupBy(a_id).agg(F.max("count").alias("most"))
    judged = counts.select("pair", "count", a_id).join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    # a pair has a row per block at most, so none is hot
    scored = rows.join(judged, "pair").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("code", "count", "best"))).alias("scores")
    ).select("block", F.col("scores.count").alias("counts"), F.col("scores.best").alias("best"))

    def score(texts: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        counts = np.asarray(block["counts"].iloc[0], np.int64) if len(block) else np.zeros(0, np.int64)
        top = np.asarray(block["best"].iloc[0], bool) if len(block) else np.zeros(0, bool)
        n_best, total = [], []
        for codes, mult in zip(texts["codes"], texts["mult"], strict=True):
            at, m = np.cumsum(unpacked(codes, np.int32)), unpacked(mult, np.int64)
            n_best.append(int(m[top[at]].sum()))
            total.append(int((m * counts[at]).sum()))
        return texts[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].assign(n_best=n_best, count_sum=total)

    out = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    # one group is one block, whose size is bounded
    texts = held.where("pairs is null").drop("pairs", "docs").withColumnRenamed("block", "of_block")
    return texts.groupBy("of_block").cogroup(scored.groupBy("block")).applyInPandas(score, out)
