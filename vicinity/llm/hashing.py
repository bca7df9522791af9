"""64-bit hashes of words and of runs of words, by numpy over whole batches of texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    size = 1 << max(10, (n - 1).bit_length())
    return _powers(size, base)[:n] if size <= 1 << 22 else np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1 if len(raw) else np.empty(0, np.int64)
    edges = np.concatenate([[0] if len(raw) and not space[0] else [], edge, [len(raw)] if len(raw) and not space[-1] else []]).astype(np.int64)
    return edges[::2], edges[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes; words are taken in chunks, so memory follows the chunk and not the text."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _CHUNK, "right")))
        s, e = starts[first:last], ends[first:last]
        size = e - s
        base = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(base[-1]) - np.repeat(base[:-1], size)
        values = (raw[np.repeat(s, size) + place].astype(np.uint64) + np.uint64(1)) * mix(powers(int(size.max())))[place]
        out[first:last] = mix(np.add.reduceat(values, base[:-1]) + size.astype(np.uint64))
        first = last
    return out


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and where each text's begin (with the end last)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = word_spans(raw)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    return word_hashes(raw, starts, ends), np.searchsorted(starts, begin)


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words, by its first word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if length <= 8:
        out = np.zeros(n, np.uint64)
        for j in range(length):
            out = out * np.uint64(_BASE) + words[j : j + n]
        return mix(out)
    out = np.empty(n, np.uint64)
    for first in range(0, n, _CHUNK):
        some = words[first : first + _CHUNK + length - 1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(some * powers(len(some)), dtype=np.uint64)])
        m = len(some) - length + 1
        out[first : first + m] = (total[length:] - total[:m]) * powers(m, _INVERSE)
    return mix(out)
