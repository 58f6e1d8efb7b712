"""Suffix trees of many short symbol sequences at once, and their tandem repeats after Stoye and Gusfield.

All is array work: ranks of prefixes of doubled length give the suffix array,
the lengths of common prefixes of neighbours give the inner nodes as
intervals of the suffix array, and each node's children as parts of its own.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a comparison step when repeats are rotated to the left, over all repeats.
_STEP = 1 << 20


class SuffixTree:
    """The suffix tree of `symbols`, in which every sequence has symbols of its own and ends in one that occurs once.

    depth, low, high: of each inner node but the root, the symbols of its label
    and the part [low, high) of the suffix array that is its list of leaves.
    child_node, child_low, child_high: the children of those nodes.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self.levels = _ranks(symbols)
        self.rank = self.levels[-1]
        self.order = np.empty_like(self.rank)
        self.order[self.rank] = np.arange(self.rank.size, dtype=self.rank.dtype)
        common = self._common()
        self.levels = []
        self._nodes(common)

    def _common(self) -> np.ndarray:
        """Symbols that each suffix shares with the one before it in order; 0 at both ends."""
        out = np.zeros(self.order.size + 1, dtype=np.int64)
        at = np.flatnonzero(self.symbols[self.order[1:]] == self.symbols[self.order[:-1]]) + 1
        a, b = self.order[at - 1].astype(np.int64), self.order[at].astype(np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][a] == self.levels[k][b]).astype(np.int64) << k
            a, b = a + step, b + step
        out[at] = a - self.order[at - 1]
        return out

    def _nodes(self, common: np.ndarray) -> None:
        inner = np.flatnonzero(common)
        sides = []
        for step in (-1, 1):
            # Between a place and the one it points at, all share as much as it does; pointers of pointers get there fast.
            pointer = np.arange(common.size) + step
            open_ = inner
            while (open_ := open_[common[pointer[open_]] >= common[open_]]).size:
                pointer[open_] = pointer[pointer[open_]]
            sides.append(pointer[inner])
        key = sides[0] * common.size + sides[1]
        order = np.argsort(key, kind="stable")
        key, splits = key[order], inner[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, np.int64)
        self.low, self.high = key[first] // common.size, key[first] % common.size
        self.depth = common[splits[first]]
        each = np.diff(np.append(first, key.size))
        node = np.repeat(np.arange(first.size), each)
        place = np.arange(key.size) + node
        self.child_node = np.repeat(np.arange(first.size), each + 1)
        self.child_low = np.empty(self.child_node.size, dtype=np.int64)
        self.child_high = np.empty(self.child_node.size, dtype=np.int64)
        self.child_low[first + np.arange(first.size)] = self.low
        self.child_low[place + 1] = splits
        self.child_high[place] = splits
        self.child_high[first + np.arange(first.size) + each] = self.high

    def branching_repeats(self, exponent: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """(end, period) of the tandem repeats that the next symbol breaks, of nodes of `exponent` leaves at least.

        Smaller-half traversal: of each node the leaves of all children but the
        largest are listed; a repeat has one end at least in that list, so each
        leaf is tried with its node's depth added and taken away. A run in which
        the period fits `exponent` times has as many leaves below its node, so
        nodes of fewer can be left out. Sorted by end, then period; each once.
        """
        sizes = self.child_high - self.child_low
        largest = np.lexsort((np.arange(sizes.size), -sizes, self.child_node))
        largest = largest[np.flatnonzero(np.diff(self.child_node[largest], prepend=-1))]
        small = (self.high - self.low >= exponent)[self.child_node]
        small[largest] = False
        lengths, node = sizes[small], self.child_node[small]
        if not lengths.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(lengths)
        leaf = np.repeat(self.child_low[small] - (ends - lengths), lengths) + np.arange(ends[-1])
        node = np.repeat(node, lengths)
        depth, start = self.depth[node], self.order[leaf].astype(np.int64)
        found = []
        for other, first in ((start + depth, start), (start - depth, start - depth)):
            inside = np.flatnonzero((other >= 0) & (other < self.rank.size))
            rank = self.rank[other[inside]]
            inside = inside[(rank >= self.low[node[inside]]) & (rank < self.high[node[inside]])]
            at, period = first[inside], depth[inside]
            broken = self.symbols[at + period] != self.symbols[at + 2 * period]
            found.append((at + 2 * period)[broken] * (self.rank.size + 1) + period[broken])
        key = np.unique(np.concatenate(found))
        return key // (self.rank.size + 1), key % (self.rank.size + 1)


def _ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Entry k: ranks of the suffixes by their first 2**k symbols, equal where these are; the last has no ties."""
    n = symbols.size
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = start
    levels = [rank]
    tied = order[~(fresh & np.append(fresh[1:], True))] if n else order
    step = 1
    while tied.size:
        key = rank[tied].astype(np.int64) * n + rank[tied + step]
        by = np.argsort(key, kind="stable")
        key, tied = key[by], tied[by]
        place = np.arange(tied.size)
        before = rank[tied]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], before[1:] != before[:-1]])
        rank = rank.copy()
        rank[tied] = before + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        levels.append(rank)
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return levels


def _rotated(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each repeat can be rotated to the left: equal symbols a period apart before its start."""
    out = np.zeros(start.size, dtype=np.int64)
    active, block = np.arange(start.size), 8
    while active.size:
        place = (start[active] - out[active])[:, None] - np.arange(1, block + 1)
        equal = (place >= 0) & (symbols[np.maximum(place, 0)] == symbols[np.maximum(place, 0) + period[active, None]])
        whole = equal.all(axis=1)
        out[active] += np.where(whole, block, np.argmin(equal, axis=1))
        active = active[whole]
        block = min(2 * block, max(8, _STEP // max(1, active.size)))
    return out


def maximal_runs(symbols: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all maximal runs in which the period fits `exponent` >= 2 times.

    Branching repeats of a run end with it. The one of the smallest period is
    rotated to the run's start; those of its multiples inside are the same run.
    """
    end, period = SuffixTree(symbols).branching_repeats(exponent)
    found = [np.zeros((3, 0), np.int64)]
    while end.size:
        first = np.flatnonzero(np.diff(end, prepend=-1))
        start = end[first] - 2 * period[first]
        start -= _rotated(symbols, start, period[first])
        found.append(np.stack([start, end[first], period[first]]))
        each = np.diff(np.append(first, end.size))
        start, smallest = np.repeat(start, each), np.repeat(period[first], each)
        other = (period % smallest != 0) | (end - 2 * period < start)
        end, period = end[other], period[other]
    start, end, period = np.concatenate(found, axis=1)
    kept = np.flatnonzero(end - start >= exponent * period)
    kept = kept[np.lexsort((period[kept], start[kept]))]
    return start[kept], end[kept], period[kept]
