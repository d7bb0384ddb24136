"""Subword features of whole texts, taken from their bytes in numpy without a Python step per word.

A word is a run of ASCII letters and digits and of bytes above 127 (so any UTF-8 letter outside ASCII), case folded for
ASCII and Latin-1. Its subwords are the runs of 3 to 6 bytes that lie in the word with one separator on each side."""

from __future__ import annotations

import numpy as np

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS

_FOLD = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


class Words:
    """The words of several texts: per word its text (doc), its place among the separators, and per text its count."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" " + b" ".join(texts) + b"  ", np.uint8)
        b = _FOLD[raw]
        up = np.flatnonzero((b[1:-1] >= 0x80) & (b[1:-1] <= 0x9E) & (b[1:-1] != 0x97) & (b[:-2] == 0xC3)) + 1
        b[up] += 0x20
        self.bytes = b
        seps = np.flatnonzero(b == 0x20)
        gaps = np.diff(seps)
        self.full = np.flatnonzero(gaps > 1)  # gaps that hold a word
        self.start, self.end = seps[self.full] + 1, seps[self.full + 1]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_end = np.cumsum(sizes + 1)
        self.count = np.diff(np.searchsorted(self.start, np.concatenate([[0], self.doc_end])))
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self._seps, self._next = seps, np.repeat(seps[1:], gaps)

    def grams(self):
        """For each size: the buckets of the runs that start at each byte, and whether the run lies in one word."""
        b = self.bytes.astype(np.uint32)
        h, n = b[:-1] * np.uint32(0x01000193) ^ b[1:], len(b)
        at = np.arange(len(self._next))
        for size in SIZES:
            m = n - size + 1
            h = (h[:m] * np.uint32(0x01000193)) ^ b[size - 1 :]
            bucket = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)
            k = min(m, len(self._next))
            yield bucket[:k], at[:k] + (size - 1) <= self._next[:k]

    def word_means(self, *tables: np.ndarray) -> list[np.ndarray]:
        """Per table of BUCKETS numbers: each word's mean over its subwords."""
        n, base = len(self._next), int(self._seps[0])
        if not len(self.full):
            return [np.empty(0, np.float32) for _ in tables]
        sums, count = [np.zeros(n, np.float32) for _ in tables], np.zeros(n, np.float32)
        for bucket, inside in self.grams():
            k = len(bucket)
            count[:k] += inside
            for s, t in zip(sums, tables):
                s[:k] += t[bucket] * inside
        at = self._seps[:-1] - base
        count = np.add.reduceat(count, at)[self.full]
        return [np.add.reduceat(s, at)[self.full] / np.maximum(count, 1) for s in sums]

    def matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, bucket, 1 / subwords of the word) of all subwords."""
        owner = np.full(len(self._seps), -1)
        owner[self.full] = np.arange(len(self.full))
        owner = np.repeat(owner[:-1], np.diff(self._seps))
        words, buckets = [], []
        for bucket, inside in self.grams():
            at = np.flatnonzero(inside & (owner[: len(bucket)] >= 0))
            words.append(owner[at])
            buckets.append(bucket[at].astype(np.int64))
        word, bucket = np.concatenate(words), np.concatenate(buckets)
        return word, bucket, 1.0 / np.bincount(word, minlength=max(1, len(self.full)))[word]


def collapsed(words: Words, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, words per text, places) without words that repeat the one before them in the same text."""
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (words.doc[1:] != words.doc[:-1])
    at = np.flatnonzero(keep)
    return values[at], np.bincount(words.doc[at], minlength=len(words.count)), at


def window_sums(values: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the largest sum of so many consecutive values (of all, if fewer) and where it starts; a text without
    values has 0."""
    best, where = np.zeros(len(count)), np.zeros(len(count), np.int64)
    if not len(values):
        return best, where
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    first = np.cumsum(count) - count
    for i in np.flatnonzero(count):
        a, n = first[i], count[i]
        w = min(n, window)
        runs = sums[a + w : a + n + 1] - sums[a : a + n - w + 1]
        where[i] = k = int(runs.argmax())
        best[i] = runs[k]
    return best, where
