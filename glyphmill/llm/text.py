"""Vectorised words of many texts: bounds and 64-bit hashes by numpy, without a Python object per word."""

from __future__ import annotations

import numpy as np

#: Word classes over UTF-8 bytes: ASCII letters and digits with all of U+0080 and up; or all but white space.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
PIECE = 1 << 20


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * len(_POWERS)), _BASE)]))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words(texts: list[bytes | None], solid: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and n+1 bounds of each text's words among them."""
    return found_words(texts, solid)[:2]


def found_words(texts: list[bytes | None], solid: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words(), the lower-cased bytes of all texts, and the words' starts and lengths in them."""
    raw = b"\n".join(t or b"" for t in texts)
    data = LOWER[np.frombuffer(raw, np.uint8)]
    ends = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)
    found, at, sizes = [], [], []
    i = 0
    while i < len(data):
        j = min(len(data), i + PIECE)
        while j < len(data) and solid[data[j - 1]] and solid[data[j]]:  # cut between words
            step = np.flatnonzero(~solid[data[j : j + PIECE]])
            j = j + int(step[0]) if len(step) else min(len(data), j + PIECE)
        piece = data[i:j]
        is_word = solid[piece]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if len(start):
            length = end - start
            within = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
            with np.errstate(over="ignore"):
                value = _VALUE[piece[is_word]] * powers(int(length.max()) + 1)[within]
                h = np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64)
            found.append(mix(h))
            at.append(start + i)
            sizes.append(length)
        i = j
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    hashes, starts = join(found, np.uint64), join(at, np.int64)
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64), data, starts, join(sizes, np.int64)
