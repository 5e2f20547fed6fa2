"""Vectorised hashing of words, shingles and spans over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one pass looks at; longer texts are cut at a byte outside words.
CHUNK = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
WORD_BYTES = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Bytes that end a sentence.
END_BYTES = np.isin(np.arange(256), list(b".!?\n"))

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, min(1 << (n - 1).bit_length(), CHUNK + 1))  # a run has CHUNK bytes at most
        _powers = tuple(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of a run of bytes: the text each belongs to, its hash, where it starts and ends, its sentence."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    @property
    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, lower: bool = True) -> Iterator[Words]:
    """Words of all texts of a column, about CHUNK bytes at a time; a long text comes in several runs, in order.

    Sentences are numbered within a run, and a sentence ends with its text.  Copies in lower case are of a few runs.
    """
    for lo, hi in slices(column):
        for words in _chunks(column.slice(lo, hi - lo), lower):
            words.text += lo
            yield words


def _chunks(column: pa.Array, lower: bool) -> Iterator[Words]:
    data, offsets = _bytes(pc.utf8_lower(column.cast(pa.large_string())) if lower else column)
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        stop = min(last, at + CHUNK)
        if stop < last:  # cut where a text ends; a text longer than a run after a byte outside words, if it has any
            edge = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            outside = np.flatnonzero(~WORD_BYTES[data[at:stop]]) if edge <= at else []
            stop = edge if edge > at else at + int(outside[-1]) + 1 if len(outside) else stop
        part = data[at:stop]
        inside = WORD_BYTES[part]
        first = np.searchsorted(offsets, at, "right") - 1
        breaks = offsets[first : np.searchsorted(offsets, stop, "left")] - at
        breaks = breaks[breaks > 0]
        new = np.zeros(len(part) + 1, bool)
        new[breaks] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        start = np.flatnonzero(inside & (~before | new[:-1]))
        end = np.flatnonzero(inside & (~after | new[1:])) + 1
        power, inverse = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)  # in place: eight bytes for each of the run's are held once
        np.add(part, np.uint64(1), out=sums[1:])
        sums[1:] *= power[:-1]
        np.cumsum(sums[1:], out=sums[1:])
        ends = END_BYTES[part] | new[:-1]
        yield Words(np.searchsorted(offsets, start + at, "right") - 1, start, end, np.cumsum(ends, dtype=np.int32)[start], sums, inverse)
        at = stop


def slices(column: pa.Array, limit: int = 4 * CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes together; a longer text stands alone."""
    _, offsets = _bytes(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, rows)
        lo = hi


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every lower-case word of a column, in order."""
    found = [(w.text, w.hashes) for w in chunks(column)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shingles(text: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``size`` words; a text of fewer words has one shingle, of all its words."""
    if not len(text):
        return text, word
    total = np.zeros(len(word), np.uint64)
    n = len(word)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    left = np.repeat(first + count, count) - np.arange(n)  # words from here to the text's end
    for k in range(size):
        factor = np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        here = word[k:] * factor
        np.add(total[: n - k], np.where(left[: n - k] > k, here, np.uint64(0)), out=total[: n - k])
    whole = (left >= size) | ((np.arange(n) == np.repeat(first, count)) & (np.repeat(count, count) < size))
    return text[whole], mix(total[whole])
