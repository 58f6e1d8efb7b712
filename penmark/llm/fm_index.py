"""Word-level FM-index of one shard of texts, vectorised over all phrases of a search."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; the symbols are positive.

    Ranks by as many leading symbols as one 63-bit key holds, then doubles the
    compared length for those suffixes only that are still tied.
    """
    n = symbols.size
    bits = int(symbols.max(initial=1)).bit_length()
    width = max(1, 63 // bits)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(width, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for i in range(width):
        key = key << bits | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, dtype=np.int64)  # the last is that of the empty suffix
    slots, key = np.arange(n), key[order]
    while slots.size:
        new = np.ones(slots.size, dtype=bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        first = slots[np.flatnonzero(new)]
        rank[order[slots]] = first[group] + 1
        tied = np.bincount(group)[group] > 1
        slots = slots[tied]
        if slots.size:
            at = order[slots]
            key = rank[at] << 32 | rank[np.minimum(at + width, n)]
            within = np.argsort(key, kind="stable")
            order[slots] = at[within]
            key = key[within]
            width *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol at any position, one cumulative bit count a level."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.zeros: list[np.ndarray] = []
        for level in reversed(range(self.bits)):
            one = (symbols >> level & 1).astype(bool)
            zeros = np.zeros(symbols.size + 1, dtype=np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.zeros.append(zeros)
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its end position."""
        low = np.zeros_like(end)
        for i, zeros in enumerate(self.zeros):
            one = (symbol >> (self.bits - 1 - i) & 1).astype(bool)
            z_low, z_end, total = zeros[low], zeros[end], zeros[-1]
            low = np.where(one, total + low - z_low, z_low)
            end = np.where(one, total + end - z_end, z_end)
        return end - low


class FMIndex:
    """Index of positive `symbols` with every `sample`-th suffix position kept."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        symbols = np.concatenate([symbols, [0]])  # the end, smaller than all else
        n = symbols.size
        order = np.concatenate([[n - 1], suffix_array(symbols[:-1])])
        self.last = symbols[order - 1]
        largest = int(symbols.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))])
        self.tree = WaveletMatrix(self.last, largest)
        kept = order % sample == 0
        self.kept, self.kept_before = kept, np.cumsum(kept) - 1
        self.positions = order[kept]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of right-aligned phrases; a symbol of -1 to the left of a phrase stands for none."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for column in reversed(range(phrases.shape[1])):
            live = np.flatnonzero((phrases[:, column] >= 0) & (high > low))
            symbol = phrases[live, column]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps to the left until a kept position is met."""
        found = np.zeros(rows.size, dtype=np.int64)
        at, steps, open_ = rows.copy(), 0, np.arange(rows.size)
        while open_.size:
            done = self.kept[at]
            found[open_[done]] = self.positions[self.kept_before[at[done]]] + steps
            at, open_ = at[~done], open_[~done]
            symbol = self.last[at]
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return found
