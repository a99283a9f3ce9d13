"""Byte n-grams of words, as numbers, for the language models of this subpackage.

A word stands between two blanks. Each of its bytes and the blank behind it is predicted from up
to ``order - 1`` bytes before it, never from before the word. An n-gram of length L is the number
made of its bytes, with L in the top byte.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

#: everything ASCII but letters separates words
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
TAG = np.uint64(56)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).lower().split()


def suffix(keys: np.ndarray, length) -> np.ndarray:
    """The n-grams' last ``length`` bytes, as n-grams of that length."""
    length = np.asarray(length, np.uint64)
    return (keys & ((np.uint64(1) << (length * np.uint64(8))) - np.uint64(1))) | (length << TAG)


def contexts(keys: np.ndarray) -> np.ndarray:
    """The n-grams without their last byte."""
    length = keys >> TAG
    return ((keys & ((np.uint64(1) << TAG) - np.uint64(1))) >> np.uint64(8)) | ((length - np.uint64(1)) << TAG)


def ngrams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram and word number of every predicted byte of the words."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    full = np.zeros(len(data), np.uint64)
    for j in range(order):
        full[j:] |= data[:len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    blank = data == 32
    number = np.cumsum(blank) - blank  # blanks before each byte
    begin = np.flatnonzero(blank)[np.maximum(number - 1, 0)]
    length = np.minimum(np.arange(len(data)) - begin + 1, order).astype(np.uint64)
    return suffix(full, length)[1:], (number - 1)[1:]


def weighted_counts(words: Counter, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of counted words, and how often each occurs."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, number = ngrams(list(words), order)
    weight = np.fromiter(words.values(), np.int64, len(words))[number]
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=weight).astype(np.int64)


class WordScores(dict):
    """Scores of words, computed for many new words at once and remembered (bounded)."""

    def __init__(self, score, most: int = 300_000):
        super().__init__()
        self.score, self.most = score, most

    def learn(self, words: set[bytes]) -> None:
        if len(self) > self.most:
            self.clear()
        new = [w for w in words if w not in self]
        if new:
            self.update(zip(new, self.score(new)))


def slices(rows: list, size: int) -> Iterator[list]:
    for i in range(0, len(rows), size):
        yield rows[i:i + size]
