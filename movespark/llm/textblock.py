"""Blocks of texts as flat byte arrays: words, their hashes and per-document sums without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(1)
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    n = max(BLOCK + 1, n)
    if n not in _powers:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[n] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """Texts lo..hi of a batch. starts, ends: of the words, in bytes; first: index of each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False, between: np.ndarray = _SPACE):
        self.lo, self.hi, self.offsets = lo, hi, offsets - offsets[0]
        self.sums_of: np.ndarray | None = None
        self.data = _LOWER[data] if lower else data
        word = ~between[self.data]
        before, after = np.empty(len(word), bool), np.empty(len(word), bool)
        before[1:], after[:-1] = ~word[:-1], ~word[1:]
        before[self.offsets[:-1][self.offsets[:-1] < len(word)]] = True
        after[self.offsets[1:][self.offsets[1:] > 0] - 1] = True
        self.word = word
        self.starts, self.ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.first)

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Per text, how many bytes the mask marks."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hashes of runs of bytes, by their bytes alone."""
        if self.sums_of is None:
            up, self.down = _power_table(len(self.data) + 1)
            self.sums_of = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_bytes_table()[self.data] * up[: len(self.data)], out=self.sums_of[1:])
        return mixed((self.sums_of[starts + lengths] - self.sums_of[starts]) * self.down[starts] + lengths.astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends - self.starts)

    def with_beginnings(self, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, then of the beginnings of so many bytes of longer words, and the word that each is of."""
        length, words = self.ends - self.starts, np.arange(len(self.starts))
        parts = [(words, length), *((w, np.full(len(w), n)) for n in sizes for w in [np.flatnonzero(length > n)])]
        return np.concatenate([self.hashes(self.starts[w], n) for w, n in parts]), np.concatenate([w for w, _ in parts])

    def windows(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words in a row inside one text, and the index of each window's first word."""
        if len(h) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out += h[k : len(h) - n + 1 + k] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        text = np.repeat(np.arange(len(self.n_words)), self.n_words)
        inside = np.flatnonzero(text[: len(out)] == text[n - 1 :])
        return mixed(out[inside]), inside


def blocks(texts: pa.Array, lower: bool = False, between: np.ndarray = _SPACE, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of whole texts of about `size` bytes; null texts are empty. `between` marks the bytes that separate words."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buf, np.uint8) if buf else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], lo, hi, lower, between)
        lo = hi
