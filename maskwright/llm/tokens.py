"""Token ids of whole texts, with bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from maskwright.llm.common import text_slices
from maskwright.llm.shingles import word_bounds, word_hashes

_known: dict[str, TextIds] = {}


#: A special token that the tokenizers have; it parts words that are encoded together.
MARK = "<|endoftext|>"
_TOGETHER = 2000


class TextIds:
    """Ids of whole texts, looked up by 64-bit word hashes a run of texts at a time.

    Holds for tokenizers whose pre-tokenizer drops white space, as
    ``word_bpe_49k.json``: a text's ids are then those of its words in order. The
    distinct words of a run are looked up among at most ``size`` known ones; the
    others are encoded once. Ids then come from one gather over the pool of all known
    words' ids.
    """

    def __init__(self, path: str, size: int = 1_200_000):
        self.tokenizer, self.size = Tokenizer.from_file(path), size
        self.mark = self.tokenizer.token_to_id(MARK)
        self._reset()

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's begin and end."""
        if any(MARK in word for word in words):
            each = [self.tokenizer.encode(word, add_special_tokens=False).ids for word in words]
            return np.array([x for ids in each for x in ids], np.uint32), np.cumsum([0, *map(len, each)])
        ids = np.array(self.tokenizer.encode(f" {MARK} ".join(words), add_special_tokens=False).ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.concatenate([[0], marks - np.arange(len(marks)), [len(ids) - len(marks)]])

    def _reset(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        parts, n = [], []
        for first in range(0, len(words), _TOGETHER):
            ids, edges = self._encoded(words[first : first + _TOGETHER])
            parts.append(ids)
            n.append(np.diff(edges))
        n = np.concatenate(n)
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate([self.pool, *parts])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.n, place, n)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a run, and where each text's begin and end."""
        starts, ends, of = word_bounds(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, first, which = np.unique(word_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.size:
            self._reset()
        new = np.flatnonzero(self.keys[self._places(keys)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            whole, own = data.tobytes(), first[new]
            self._learn(keys[new], [whole[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
        places = self._places(keys)
        n, at = self.n[places][which], self.at[places][which]
        before = np.cumsum(n) - n
        ids = self.pool[np.repeat(at - before, n) + np.arange(int(n.sum()))]
        edges = np.append(before, len(ids))[np.searchsorted(of, np.arange(len(offsets)))]
        return ids, edges

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, bytes]]:
        """(row, ids as little-endian 32-bit bytes) of each text."""
        for first, _, data, offsets in text_slices(texts, 1 << 21):
            ids, edges = self.run(data, offsets)
            raw = ids.astype("<u4", copy=False).tobytes()
            edges = (edges * 4).tolist()
            for row, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                yield first + row, raw[a:b]


def text_ids(path: str) -> TextIds:
    """The encoder of this process for a tokenizer file."""
    if path not in _known:
        _known[path] = TextIds(path)
    return _known[path]
