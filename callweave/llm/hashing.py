"""Words of Arrow texts as 64-bit hashes, without a Python object for any word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20  # bytes hashed at a time: bounds memory, never the result

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown to the longest piece seen."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=np.uint64))
        return cls.up, cls.down


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them. A null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data and data.size else np.zeros(0, np.uint8)), offsets


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges that end with a text or at a blank."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = int(offsets[np.searchsorted(offsets, at + PIECE_BYTES, "right") - 1])
        if to <= at:  # one text is longer than a piece
            text_end, to = int(offsets[np.searchsorted(offsets, at, "right")]), at + PIECE_BYTES
            while to < text_end:
                blank = np.flatnonzero(_BLANK[data[to : min(to + PIECE_BYTES, text_end)]])
                if len(blank):
                    to += int(blank[0])
                    break
                to = min(to + PIECE_BYTES, text_end)
        yield at, to
        at = to


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, A-Z lower-cased, and the n + 1 word offsets of the texts."""
    data, offsets = _text_bytes(texts)
    hashes, starts_all = [], []
    for at, to in _cuts(data, offsets):
        low = _LOWER[data[at:to]]
        word = ~_BLANK[low]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = offsets[(offsets > at) & (offsets < to)] - at  # a text's end also ends a word
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _Powers.of(to - at + 1)
        sums = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low] * up[: to - at], dtype=np.uint64, out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts]))
        starts_all.append(starts + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_all), offsets, "left").astype(np.int64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of one text, sorted; with fewer words, the whole sequence as one; without words, none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    with np.errstate(over="ignore"):
        joined = np.full(n - width + 1, width if width < size else size, dtype=np.uint64)
        for k in range(width):
            joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k])
    return np.unique(joined)
