"""Shapley values of tree ensembles, for each row and feature.

A tree's value of a set of features is its expectation over a background where
the other features are unknown: at a split on one of them both sides count, by
the share of background rows that went there. The Shapley values of all
features come from one walk through the tree, which keeps, for every number of
known features, the total weight of the subsets of the path that have it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """Nodes in preorder, the root first: a split goes left where its feature is at most the threshold; a leaf's feature is -1."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]
    cover: tuple[float, ...] = ()

    @property
    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]

    def covered(self, leaf_counts: Sequence[float]) -> Tree:
        """The tree with the rows that reach each node, given those of its leaves; a tree that none reach is covered evenly."""
        counts = list(leaf_counts) if sum(leaf_counts) else [1.0] * len(self.leaves)
        cover = np.zeros(len(self.feature))
        cover[self.leaves] = counts
        for i in range(len(self.feature) - 1, -1, -1):
            if self.feature[i] >= 0:
                cover[i] = cover[self.left[i]] + cover[self.right[i]]
        return Tree(self.feature, self.threshold, self.left, self.right, self.value, tuple(cover.tolist()))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf, by its place among the leaves, that each row of `x` reaches."""
        at, split = np.zeros(len(x), dtype=np.int64), np.array(self.feature)
        place = np.zeros(len(split), dtype=np.int64)
        place[self.leaves] = np.arange(len(self.leaves))
        while (open_ := np.flatnonzero(split[at] >= 0)).size:
            node = at[open_]
            goes_left = x[open_, split[node]] <= np.array(self.threshold)[node]
            at[open_] = np.where(goes_left, np.array(self.left)[node], np.array(self.right)[node])
        return place[at]


def trees_of(model: GBTClassificationModel) -> list[Tree]:
    """The trees of a boosted model, values multiplied by the trees' weights, not yet covered."""
    out = []
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        rows: list[list] = []

        def walk(node, rows: list[list] = rows, weight: float = weight) -> int:
            at = len(rows)
            rows.append([-1, 0.0, 0, 0, weight * node.prediction()])
            if node.numDescendants():
                cut = node.split()
                rows[at][0], rows[at][1] = cut.featureIndex(), cut.threshold()
                rows[at][2] = walk(node.leftChild())
                rows[at][3] = walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        out.append(Tree(*map(tuple, zip(*rows, strict=True))))
    return out


def _matrix(pdf: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    return pdf[list(features)].to_numpy(dtype=np.float64, na_value=0.0)


def _features(rows: DataFrame, features: Sequence[str], *more: str) -> DataFrame:
    return rows.select(*more, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])


def covered(trees: Sequence[Tree], background: DataFrame, features: Sequence[str]) -> list[Tree]:
    """`trees` with the background's rows counted in their leaves; one row for each leaf and task comes out of the scan."""
    trees = list(trees)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(len(t.leaves), dtype=np.int64) for t in trees]
        for batch in batches:
            x = _matrix(batch, features)
            for total, tree in zip(sums, trees, strict=True):
                total += np.bincount(tree.leaf_of(x), minlength=total.size)
        parts = [pd.DataFrame({"tree": i, "leaf": np.arange(s.size), "n": s}) for i, s in enumerate(sums)]
        yield pd.concat(parts) if parts else pd.DataFrame({"tree": [], "leaf": [], "n": []})

    found = _features(background, features).mapInPandas(counted, "tree int, leaf int, n bigint").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    counts = [np.zeros(len(t.leaves)) for t in trees]
    for r in found.collect():
        counts[r["tree"]][r["leaf"]] = r["n"]
    return [t.covered(c) for t, c in zip(trees, counts, strict=True)]


class _Path:
    """The features on the way to a node: share of the background that follows (zero), whether a row does (one), weights of subsets by size."""

    def __init__(self, rows: int):
        self.features: list[int] = []
        self.zero: list[float] = []
        self.one: list[np.ndarray] = []
        self.weights = np.ones((1, rows))

    def extended(self, feature: int, zero: float, one: np.ndarray) -> _Path:
        out = _Path(0)
        out.features, out.zero, out.one = [*self.features, feature], [*self.zero, zero], [*self.one, one]
        n = len(self.features)
        sizes = np.arange(n + 1)[:, None]
        out.weights = np.zeros((n + 2, self.weights.shape[1]))
        out.weights[:-1] = zero * self.weights * (n + 1 - sizes) / (n + 2)
        out.weights[1:] += one * self.weights * (sizes + 1) / (n + 2)
        return out

    def _without(self, k: int) -> np.ndarray:
        """The weights as they would be without feature k: the extension undone, from the top where a row follows, from the bottom where not."""
        n, zero, one = len(self.features), self.zero[k], self.one[k]
        follows = one > 0
        weights, above = np.zeros((n, one.size)), self.weights[n].copy()
        for i in range(n - 1, -1, -1):
            down = above * (n + 1) / (i + 1)
            flat = self.weights[i] * (n + 1) / (zero * (n - i)) if zero else np.zeros(one.size)
            weights[i] = np.where(follows, down, flat)
            above = self.weights[i] - zero * weights[i] * (n - i) / (n + 1)
        return weights

    def dropped(self, k: int) -> _Path:
        out = _Path(0)
        out.features, out.zero, out.one = (c[:k] + c[k + 1 :] for c in (self.features, self.zero, self.one))
        out.weights = self._without(k)
        return out

    def credit(self, value: float, into: np.ndarray) -> None:
        """Adds a leaf's value to its path's features."""
        for k, feature in enumerate(self.features):
            into[:, feature] += self._without(k).sum(axis=0) * (self.one[k] - self.zero[k]) * value


def shapley_values(tree: Tree, x: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """(values of each row and feature, expectation over the background) of a covered tree."""
    out = np.zeros((len(x), n_features))
    expected = 0.0

    def walk(node: int, path: _Path, share: float) -> None:
        nonlocal expected
        feature = tree.feature[node]
        if feature < 0:
            expected += share * tree.value[node]
            path.credit(tree.value[node], out)
            return
        zero, one = 1.0, np.ones(len(x))
        if feature in path.features:
            k = path.features.index(feature)
            zero, one = path.zero[k], path.one[k]
            path = path.dropped(k)
        goes_left = (x[:, feature] <= tree.threshold[node]).astype(float)
        for child, goes in ((tree.left[node], goes_left), (tree.right[node], 1 - goes_left)):
            part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.5
            walk(child, path.extended(feature, zero * part, one * goes), share * part)

    walk(0, _Path(len(x)), 1.0)
    return out, expected


def explain(
    trees: Sequence[Tree], rows: DataFrame, features: Sequence[str], *, background: DataFrame | None = None, id_col: str = "doc_id"
) -> DataFrame:
    """(id, expected, margin, values) of each row: the trees' mean over the background, their sum for the row, and a value for each feature.

    expected + sum of values = margin. `background` (its features' columns; the
    rows themselves if null) says how often each side of a split is taken. A
    feature that a row lacks is 0. Rows with equal or null ids stay apart.
    """
    names, known = list(features), covered(trees, rows if background is None else background, features)

    def explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch, names)
            values, expected, margin = np.zeros((len(x), len(names))), 0.0, np.zeros(len(x))
            for tree in known:
                own, mean = shapley_values(tree, x, len(names))
                values += own
                expected += mean
                margin += np.array(tree.value)[tree.leaves][tree.leaf_of(x)]
            yield pd.DataFrame({id_col: batch[id_col], "expected": expected, "margin": margin, "values": list(values)})

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, expected double, margin double, values array<double>"
    return _features(rows, features, id_col).mapInPandas(explained, schema)


def ranked(explained: DataFrame, features: Sequence[str], id_col: str = "doc_id", top: int = 10) -> DataFrame:
    """(id, rank, feature, value): the `top` features of each row by the size of their values; equal ones in the order of features."""
    names = F.array(*map(F.lit, features))
    each = F.transform("values", lambda v, i: F.struct((-F.abs(v)).alias("order"), i.alias("place"), F.get(names, i).alias("feature"), v.alias("value")))
    rows = explained.select(id_col, F.posexplode(F.slice(F.array_sort(each), 1, top)).alias("rank", "own"))
    return rows.select(id_col, (F.col("rank") + 1).cast("bigint").alias("rank"), "own.feature", "own.value")
