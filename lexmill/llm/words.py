"""Words of a text and vectorised hashes of words and word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
GAP = r"[\x20\x09-\x0D]+"

def _classes(split_marks: bool) -> np.ndarray:
    """Class of every byte: 0 white space, 1 word, 2 ASCII marks if they are tokens of their own."""
    out = np.ones(256, dtype=np.int8)
    if split_marks:
        out[[c for c in range(128) if not chr(c).isalnum()]] = 2
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_CHUNK_BYTES = 1 << 20


def split_words(text: Column) -> Column:
    """Words of a text as an array; NULL counts as no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def count_words(text: Column) -> Column:
    return F.size(split_words(text)).cast("bigint")


def encoded_words(text: str | None) -> list[bytes]:
    """The same words in Python; bytes.split() cuts at ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    """Inverse of an odd number modulo 2^64."""
    return np.uint64(pow(int(base), -1, 1 << 64))


class Windows:
    """Polynomial hashes (modulo 2^64) of slices of a sequence of 64-bit numbers."""

    def __init__(self, base: np.uint64 = _BASE):
        self.base, self.back = base, inverse(base)
        self._up = self._down = np.zeros(0, dtype=np.uint64)

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up), 1 << 12)
            self._up, self._down = powers(self.base, size), powers(self.back, size)
        return self._up[:n], self._down[:n]

    def slices(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = self._tables(len(x) + 1)
        total = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x * up[:-1], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class WordHasher:
    """Word hashes of many texts at once, a bounded number of bytes at a time.

    ``split_marks`` cuts runs of ASCII marks off as tokens, ``fold`` lower-cases A-Z.
    """

    def __init__(self, split_marks: bool = False, fold: bool = False):
        self._windows, self._fold = Windows(_SECOND), fold
        self._class = _classes(split_marks)

    def chunks(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (index of the first text, word hashes, bounds); text i has words bounds[i]:bounds[i + 1]."""
        first, held, size = 0, [], 0
        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            if held and size + len(raw) > _CHUNK_BYTES:
                yield (first, *self._hash(held))
                first, held, size = i, [], 0
            held.append(raw)
            size += len(raw) + 1
        if held:
            yield (first, *self._hash(held))

    def _hash(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\n".join(raws) + b"\n"
        data = np.frombuffer(joined.lower() if self._fold else joined, dtype=np.uint8)
        kind = self._class[data]
        change = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
        start = change[kind[change] != 0]
        end = change[1:][kind[change[:-1]] != 0]
        ends = np.cumsum([len(r) + 1 for r in raws])
        bounds = np.concatenate([[0], np.searchsorted(start, ends)])
        return self._windows.slices(data.astype(np.uint64) + np.uint64(1), start, end), bounds
