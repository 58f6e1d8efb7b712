"""Vectorised byte-level text helpers shared by the numpy-backed operators.

An Arrow string column is one UTF-8 buffer plus offsets, so tokenising and
hashing run over whole batches without making a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from penmark.llm import memory  # noqa: F401

#: Multiplier of the polynomial word hash (odd, hence invertible modulo 2**64).
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}

#: Lower-cases A-Z and leaves every other byte, hence every length, alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or have.size < n:
        have = np.ones(1, dtype=np.uint64)
        step = base
        while have.size < n:
            have = np.concatenate([have, have * np.uint64(step)])
            step = step * step % (1 << 64)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `most` bytes; a longer text makes a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


class Words:
    """The words of some texts: 64-bit hash, text number and byte span of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, *, lower: bool = True):
        low = LOWER[raw] if lower else raw
        inside = word_bytes[low]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        starts_of_texts = offsets[:-1][offsets[:-1] < raw.size]
        before[starts_of_texts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[starts_of_texts[starts_of_texts > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(raw.size + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[low] * _powers(_MULTIPLIER, raw.size), out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * _powers(_INVERSE, raw.size + 1)[self.start]
        self.hash = mix(value)
        self.counts = np.searchsorted(self.start, offsets[1:]) - np.searchsorted(self.start, offsets[:-1])
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
