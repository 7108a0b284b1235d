"""Hashes of words and of runs of words, in arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CHUNK = 1 << 20
#: Words that a worker remembers. Workers live on through later stages, several at an executor, so what they keep is small.
_CACHED = 50_000
# Odd constants that mix bits.
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    """64-bit hash of a word; a bounded number is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            if len(self) >= _CACHED:
                self.clear()
            self[word] = value
        return value


_WORDS = _Words()


def word_chunks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, split at white space, a bounded part at a time."""
    at = 0
    while at < len(text):
        border = _SPACE.search(text, at + _CHUNK)
        stop = border.end() if border else len(text)
        yield text[at:stop].split()
        at = stop


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word of a whole text."""
    parts = [np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)) for words in word_chunks(text)]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two runs, the second right after the first."""
    return mixed(left * _A + right)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; runs of a length are doubled until they are long enough."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    done, length, power, width = None, 0, hashes, 1
    while True:
        if n & width:
            done = power if done is None else joined(done[: len(done) - width], power[length:])
            length += width
        if length == n:
            return done[:size]
        power, width = joined(power[:-width], power[width:]), 2 * width
