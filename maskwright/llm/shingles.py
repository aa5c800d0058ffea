"""Word and shingle hashes of UTF-8 text, in numpy over runs of documents."""

from __future__ import annotations

import numpy as np

from maskwright.llm.common import SPACE_CHARS

SHINGLE_WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240601))
_EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE = _EXACT.copy()
for _upper in range(ord("A"), ord("Z") + 1):
    _BYTE[_upper] = _BYTE[_upper + 32]
_PLACE = _rng.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_SHORT = _rng.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE_CHARS]] = True

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of them."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _powers = np.full(size, _BASE, np.uint64)
        _inverses = np.full(size, inverse, np.uint64)
        _powers[0] = _inverses[0] = 1
        _powers, _inverses = np.multiply.accumulate(_powers), np.multiply.accumulate(_inverses)
    return _powers, _inverses


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; no word crosses a document's end."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = _IS_SPACE[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[edges] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[edges - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash of bytes, and the base's inverse powers."""
    powers, inverses = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_EXACT[data] * powers[: len(data)], out=sums[1:])
    return sums, inverses


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; fold: A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE if fold else _EXACT)[data] * powers[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 5-word shingle hashes of each document.

    A document of one to four words has one, of its whole sequence; one without
    words has none.
    """
    starts, ends, of = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    docs = len(offsets) - 1
    firsts = np.searchsorted(of, np.arange(docs + 1))
    k = SHINGLE_WORDS
    rolled = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for place in range(k):
        rolled += words[place : place + len(rolled)] * _PLACE[place]
    rolled = mixed(rolled)
    sets = []
    for first, end in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        n = end - first
        if n >= k:
            sets.append(np.unique(rolled[first : end - k + 1]))
        elif n:
            whole = words[first:end] * _PLACE[:n]
            sets.append(mixed(whole.sum(dtype=np.uint64, keepdims=True) + _SHORT[n]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
