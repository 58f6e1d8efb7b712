"""Shapley values against the sum over all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.operators import boosting, shapley
from penmark.operators.shapley import Tree


def some_tree(rng, n_features, depth):
    rows = []

    def walk(d):
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, float(rng.normal())])
        if d < depth and (d == 0 or rng.random() < 0.85):
            rows[at][:2] = int(rng.integers(n_features)), float(rng.normal())
            rows[at][2] = walk(d + 1)
            rows[at][3] = walk(d + 1)
        return at

    walk(0)
    return Tree(*map(tuple, zip(*rows, strict=True)))


def value(tree, x, known, node=0):
    feature = tree.feature[node]
    if feature < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if feature in known:
        return value(tree, x, known, left if x[feature] <= tree.threshold[node] else right)
    share = tree.cover[left] / tree.cover[node] if tree.cover[node] else 0.5
    return share * value(tree, x, known, left) + (1 - share) * value(tree, x, known, right)


def literal(tree, x, n):
    out = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        out.append(sum(
            math.factorial(m) * math.factorial(n - m - 1) / math.factorial(n) * (value(tree, x, {*s, i}) - value(tree, x, set(s)))
            for m in range(n) for s in itertools.combinations(others, m)
        ))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_values_equal_the_sum_over_subsets(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    tree = some_tree(rng, n, int(rng.integers(1, 7)))
    background = rng.normal(size=(int(rng.choice([3, 200])), n))  # of three rows some splits see none
    tree = tree.covered(np.bincount(tree.leaf_of(background), minlength=len(tree.leaves)))
    x = rng.normal(size=(4, n))
    found, expected = shapley.shapley_values(tree, x, n)
    for row, own in zip(x, found, strict=True):
        assert own == pytest.approx(literal(tree, row, n), abs=1e-12)
        assert own.sum() + expected == pytest.approx(value(tree, row, set(range(n))), abs=1e-12)


def test_boosted_model(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    rows = [(None if i == 7 else i, *map(float, r), int(r[0] + r[1] * r[2] > 0)) for i, r in enumerate(x)]
    rows[8] = (8, None, *rows[8][2:])
    df = spark.createDataFrame(rows, "doc_id long, a double, b double, c double, label int").repartition(3).withColumn("values", F.lit("clash")).persist()
    model = boosting.train(df, ["a", "b", "c"], depths=(3,), rounds=4, folds=2)
    trees = shapley.covered(shapley.trees_of(model), df, ["a", "b", "c"])
    assert all(t.cover[0] == 200 for t in trees)
    explained = {r["doc_id"]: r for r in shapley.explain(shapley.trees_of(model), df, ["a", "b", "c"]).collect()}
    assert len(explained) == 200
    margins = {r["doc_id"]: r["rawPrediction"][1] for r in model.transform(boosting.assembled(df, ["a", "b", "c"])).collect()}
    for i in (0, 8, None):
        own = explained[i]
        assert own["expected"] + sum(own["values"]) == pytest.approx(own["margin"])
        row = np.array([rows[7 if i is None else i][1:4]], dtype=float)
        row = np.nan_to_num(row)[0]
        assert own["values"] == pytest.approx([sum(v) for v in zip(*(literal(t, row, 3) for t in trees), strict=True)])
        assert own["margin"] == pytest.approx(margins[i])
    top = boosting.attributions(model, df, ["a", "b", "c"], top=2).where("doc_id = 0").orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2] and abs(top[0]["value"]) >= abs(top[1]["value"])
    assert shapley.explain(trees, df.limit(0), ["a", "b", "c"]).count() == 0
