"""Sequential search of a learner's parameters by the densities of good and bad trials.

Each trial is drawn where past good trials are dense and bad ones are not. A
trial's folds are trained at once, as Spark jobs of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trials drawn evenly before densities are used, the share of good trials, and draws of which the best is tried.
FIRST_TRIALS = 8
GOOD = 0.25
DRAWS = 24


@dataclass(frozen=True)
class Range:
    """The values of a parameter: whole numbers or not, even in their logarithm or in themselves."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def value(self, unit: float) -> float | int:
        low, high = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high + self.whole)
        found = low + unit * (high - low)
        found = math.exp(found) if self.log else found
        return int(min(self.high, math.floor(found))) if self.whole else min(max(found, self.low), self.high)


@dataclass(frozen=True)
class Trial:
    units: tuple[float, ...]
    values: dict[str, float | int]
    score: float


def _density(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log density of each of `at`, by normal bumps at the points and one even bump over 0 to 1."""
    width = max(0.05, 1 / (len(points) + 1))
    bumps = np.exp(-0.5 * ((at[:, None] - points[None, :]) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    return np.log((bumps.sum(axis=1) + 1) / (len(points) + 1))


def suggested(trials: Sequence[Trial], dimensions: int, rng: np.random.Generator) -> tuple[float, ...]:
    """Where to try next, each parameter as a number of 0 to 1."""
    if len(trials) < FIRST_TRIALS:
        return tuple(rng.random(dimensions).tolist())
    ordered = sorted(trials, key=lambda t: -t.score)
    many = max(2, math.ceil(GOOD * len(ordered)))
    good, bad = (np.array([t.units for t in part]) for part in (ordered[:many], ordered[many:]))
    width = max(0.05, 1 / (len(good) + 1))
    drawn = good[rng.integers(len(good), size=DRAWS)] + rng.normal(scale=width, size=(DRAWS, dimensions))
    drawn[0] = rng.random(dimensions)
    drawn = np.abs(drawn)
    drawn = np.clip(np.where(drawn > 1, 2 - drawn, drawn), 0, 1)
    gain = sum(_density(good[:, k], drawn[:, k]) - _density(bad[:, k], drawn[:, k]) for k in range(dimensions))
    return tuple(drawn[int(np.argmax(gain))].tolist())


def maximised(objective: Callable[[dict[str, float | int]], float], space: dict[str, Range], trials: int, seed: int = 42) -> list[Trial]:
    """All trials, in order; equal seeds and scores give equal trials."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trials):
        units = suggested(out, len(space), rng)
        values = {name: own.value(u) for (name, own), u in zip(space.items(), units, strict=True)}
        out.append(Trial(units, values, objective(values)))
    return out


def tuned(
    estimator: Estimator, rows: DataFrame, space: dict[str, Range], evaluator: Evaluator, *, trials: int = 50, folds: int = 5, key: str = "x", seed: int = 42
) -> tuple[Model, list[Trial]]:
    """The estimator with the best trial's parameters, fitted on all rows, and the trials.

    `space` names parameters of the estimator. Rows are dealt into folds by a
    hash of their column `key`; a trial's score is the evaluator's mean over the
    folds. Of equal trials the first is best. Fewer than two folds, or a fold
    without rows on either side, is an error.
    """
    if folds < 2:
        raise ValueError("at least two folds are needed")
    dealt = rows.withColumn("__fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds))).persist()
    try:
        sizes = {r["__fold"]: r["n"] for r in dealt.groupBy("__fold").agg(F.count("*").alias("n")).collect()}
        if len(sizes) < folds:
            raise ValueError("a fold has no rows")
        with ThreadPoolExecutor(folds) as pool:

            def score(values: dict[str, float | int]) -> float:
                own = {estimator.getParam(name): value for name, value in values.items()}
                parts = [(dealt.where(F.col("__fold") != k), dealt.where(F.col("__fold") == k)) for k in range(folds)]
                return float(np.mean(list(pool.map(lambda p: evaluator.evaluate(estimator.fit(p[0], own).transform(p[1])), parts))))

            found = maximised(score, space, trials, seed)
        best = max(found, key=lambda t: t.score)
        return estimator.fit(dealt, {estimator.getParam(name): value for name, value in best.values.items()}), found
    finally:
        dealt.unpersist()
