"""Context-tree weighting over binary-decomposed byte contexts.

A text is its UTF-8 bytes with A-Z lower-cased, then END, a byte that UTF-8
never uses and that also stands before the start. Each byte is eight binary
decisions. A context is the up to DEPTH bytes before. Each decision in each
context has a Krichevsky-Trofimov estimate; the estimates of all depths are
mixed by the weights that context-tree weighting gives them after the training
counts.

All contexts are kept. A decision without counts in a context has the estimate
of the next shorter one, so each decision has a proper distribution, and so has
the text. Contexts of up to UPPER bytes are one table (256**(UPPER + 1) cells at
most); those of more are computed by shards, each with all contexts that end in
some UPPER + 1 bytes. A cell is a byte below the DEPTH bytes before it.
"""

from __future__ import annotations

from math import lgamma

import numpy as np

from penmark.llm.textbytes import LOWER

BITS = 8
CODES = 1 << BITS
DEPTH = 5
UPPER = 1
#: Ends a text and stands before its start; never part of UTF-8.
END = 255
#: Exact log-gamma of n + 1/2 and of n + 1 for small n; larger ones by Stirling's series.
_SMALL = 4096
_HALF = np.array([lgamma(n + 0.5) for n in range(_SMALL)])
_WHOLE = np.array([lgamma(n + 1) for n in range(_SMALL)])


def _log_gamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    x = n + shift
    series = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _SMALL, table[np.minimum(n, _SMALL - 1)], series)


def log_kt(n: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with these counts (last axis: zeros, ones)."""
    return _log_gamma(n[..., 0], _HALF, 0.5) + _log_gamma(n[..., 1], _HALF, 0.5) - _log_gamma(n.sum(axis=-1), _WHOLE, 1.0) - 1.1447298858494002


def decisions(counts: np.ndarray) -> np.ndarray:
    """Counts of the codes (contexts x 256) as counts of 255 binary decisions: contexts x 256 x 2, decision 0 unused.

    Decision 1 is the first bit of a code, 2 and 3 the second, and so on.
    """
    out = np.zeros((len(counts), CODES, 2), dtype=np.int64)
    for level in range(BITS):
        out[:, 1 << level : 2 << level] = counts.reshape(len(counts), 1 << level, 2, -1).sum(axis=-1)
    return out


def _estimate(n: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    total = n.sum(axis=-1)
    return np.where(total > 0, (n[..., 1] + 0.5) / (total + 1), otherwise)


def _weight(n: np.ndarray, log_below: np.ndarray) -> np.ndarray:
    """Posterior weight of a context's own estimate against those of its extensions."""
    return 1 / (1 + np.exp(np.clip(log_below - log_kt(n), -700, 700)))


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and for each element the place of its value."""
    new = np.ones(ordered.size, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new], np.cumsum(new) - 1


def summed_cells(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in order, and the sum of each one's counts."""
    order = np.argsort(cells)
    cells, n = cells[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if cells.size else np.zeros(0, dtype=np.int64)
    return cells[first], np.add.reduceat(n, first) if first.size else n[:0]


class Upper:
    """Contexts of up to UPPER bytes: what each of the longest has settled, left to longer ones, and estimates itself."""

    def __init__(self, counts: np.ndarray, log_below: np.ndarray):
        """counts of the bytes in each context of UPPER bytes; log_below: summed log probability of the trees below (both 256**UPPER x 256)."""
        below, own = [log_below], [decisions(counts)]
        for _ in range(UPPER):
            log_tree = np.logaddexp(log_kt(own[0]), below[0]) - np.log(2)
            log_tree[own[0].sum(axis=-1) == 0] = 0.0
            counts = counts.reshape(CODES, -1, CODES).sum(axis=0)
            below.insert(0, log_tree.reshape(CODES, -1, CODES).sum(axis=0))
            own.insert(0, decisions(counts))
        self.settled, self.left, self.estimate = (np.full((1, CODES), x) for x in (0.0, 1.0, 0.5))
        for n, log in zip(own, below, strict=True):
            parent = np.arange(len(n)) % len(self.settled)
            self.estimate = _estimate(n, self.estimate[parent])
            weight = _weight(n, log)
            self.settled = self.settled[parent] + self.left[parent] * weight * self.estimate
            self.left = self.left[parent] * (1 - weight)

    @classmethod
    def of(cls, settled: np.ndarray, left: np.ndarray, estimate: np.ndarray) -> Upper:
        """From its three tables."""
        out = cls.__new__(cls)
        out.settled, out.left, out.estimate = settled, left, estimate
        return out


class Shard:
    """The contexts of more than UPPER bytes, of which a shard has all that end in the same UPPER + 1 bytes.

    Only decisions that occur are held: for each depth and each bit of the byte,
    in order, the context before the bits that were decided.
    """

    def __init__(self, cells: np.ndarray, n: np.ndarray):
        """cells in order, each once, and their training counts, which may be 0."""
        self.cells = cells
        levels = {DEPTH: (cells, n)}
        for d in range(DEPTH - 1, UPPER - 1, -1):
            levels[d] = summed_cells(levels[d + 1][0] & ((1 << BITS * (d + 1)) - 1), levels[d + 1][1])
        self.upper_cells, self.upper_n = levels[UPPER]
        self.levels = {d: levels[d] for d in range(UPPER + 1, DEPTH + 1)}

    @staticmethod
    def _shorter(key: np.ndarray, depth: int, bit: int) -> np.ndarray:
        return key & ((1 << BITS * (depth - 1) + bit) - 1)

    def _bit(self, bit: int) -> tuple[dict, dict, dict, np.ndarray]:
        """By depth: decisions with their counts, places among those a byte shorter, log probability of the trees below; and places in Upper's tables."""
        own, parent, below = {}, {}, {}
        for d, (cells, n) in self.levels.items():
            key, place = runs(cells >> (BITS - bit))
            own[d] = key, np.bincount(place * 2 + (cells >> (BITS - 1 - bit) & 1), weights=n, minlength=2 * key.size).astype(np.int64).reshape(-1, 2)
            if d > UPPER + 1:
                parent[d] = np.searchsorted(own[d - 1][0], self._shorter(key, d, bit))
        log_tree = log_kt(own[DEPTH][1])
        for d in range(DEPTH - 1, UPPER, -1):
            n = own[d][1]
            below[d] = np.bincount(parent[d + 1], weights=log_tree, minlength=len(n))
            log_tree = np.where(n.sum(axis=-1) > 0, np.logaddexp(log_kt(n), below[d]) - np.log(2), 0.0)
        below[UPPER] = log_tree
        key = self._shorter(own[UPPER + 1][0], UPPER + 1, bit)
        return own, parent, below, (key >> bit) * CODES + (1 << bit) + (key & ((1 << bit) - 1))

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the tables of Upper, count of the byte and log probability of the trees below, in any order."""
        place, log_below = [], []
        for bit in range(BITS):
            _, _, below, upper = self._bit(bit)
            at, where = np.unique(upper, return_inverse=True)
            place.append(at)
            log_below.append(np.bincount(where, weights=below[UPPER], minlength=at.size))
        trees = sum(x.size for x in place)
        return (
            np.concatenate([self.upper_cells, *place]), np.concatenate([self.upper_n, np.zeros(trees, dtype=np.int64)]),
            np.concatenate([np.zeros(self.upper_cells.size), *log_below]),
        )

    def log2(self, upper: Upper) -> np.ndarray:
        """log2 probability of each cell's byte in its context."""
        total = np.zeros(self.cells.size)
        for bit in range(BITS):
            own, parent, below, at = self._bit(bit)
            settled, left, estimate = upper.settled.ravel()[at], upper.left.ravel()[at], upper.estimate.ravel()[at]
            for d in range(UPPER + 1, DEPTH):
                if d > UPPER + 1:
                    settled, left, estimate = (x[parent[d]] for x in (settled, left, estimate))
                n = own[d][1]
                estimate = _estimate(n, estimate)
                weight = _weight(n, below[d])
                settled, left = settled + left * weight * estimate, left * (1 - weight)
            last = parent[DEPTH]
            one = settled[last] + left[last] * _estimate(own[DEPTH][1], estimate[last])
            one = one[runs(self.cells >> (BITS - bit))[1]]
            total += np.log2(np.where(self.cells >> (BITS - 1 - bit) & 1, one, 1 - one))
        return total


def cells(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The cell of each byte and of each text's end: the oldest byte of the context in the highest bits."""
    n = len(offsets) - 1
    first = offsets[:-1] + np.arange(n) * (DEPTH + 1)
    inside = np.ones(raw.size + n * (DEPTH + 1), dtype=bool)
    for i in range(DEPTH):
        inside[first + i] = False
    at = np.flatnonzero(inside)
    inside[offsets[1:] + np.arange(n) * (DEPTH + 1) + DEPTH] = False
    codes = np.full(inside.size, END, dtype=np.uint8)
    codes[inside] = LOWER[raw]
    cell = np.zeros(at.size, dtype=np.int64)
    for back in range(DEPTH, -1, -1):
        cell <<= BITS
        cell |= codes[at - back]
    return cell
