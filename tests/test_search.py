"""Sequential search: ranges, better trials than a grid of the same size, folds in Spark."""

import itertools

import numpy as np
import pytest

from penmark.operators import boosting, search
from penmark.operators.search import Range


def test_ranges():
    assert [Range(2, 6, whole=True).value(u) for u in (0, 0.19, 0.21, 1)] == [2, 2, 3, 6]
    assert Range(0.01, 1, log=True).value(0.5) == pytest.approx(0.1)
    assert {Range(1, 100, whole=True, log=True).value(u) for u in np.linspace(0, 1, 5000)} == set(range(1, 101))


def test_search_beats_a_grid_of_the_same_size():
    space = {c: Range(0, 1) for c in "abcd"}
    better = []
    for seed in range(20):
        peak = np.random.default_rng(seed + 100).random(4)
        objective = lambda v, peak=peak: -sum((x - p) ** 2 for x, p in zip(v.values(), peak, strict=True))
        found = search.maximised(objective, space, 81, seed)
        grid = max(objective(dict(zip("abcd", at, strict=True))) for at in itertools.product((1 / 6, 1 / 2, 5 / 6), repeat=4))
        better.append(max(t.score for t in found) > grid)
        assert found == search.maximised(objective, space, 81, seed)
    assert sum(better) >= 16


def test_boosting_parameters(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(160, 2))
    rows = [(*map(float, r), int(r[0] > 0) if rng.random() > 0.1 else int(r[1] > 0)) for r in x]
    df = spark.createDataFrame([*rows, (None, 1.0, 1)], "a double, b double, label int").repartition(2)
    space = {"maxDepth": Range(1, 3, whole=True), "maxIter": Range(1, 3, whole=True), "stepSize": Range(0.1, 0.5, log=True)}
    model, trials = boosting.search(df, ["a", "b"], trials=3, folds=2, space=space)
    best = max(trials, key=lambda t: t.score)
    assert len(trials) == 3 and best.score > 0.75 and model.getOrDefault("maxIter") == best.values["maxIter"]
    assert set(boosting.SPACE) <= {p.name for p in model.params}
    with pytest.raises(ValueError):
        boosting.search(df.limit(1), ["a", "b"], trials=1, folds=2, space=space)
    with pytest.raises(ValueError):
        boosting.search(df, ["a", "b"], trials=1, folds=1)
