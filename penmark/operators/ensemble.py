"""Combining detectors: long rows (id, detector, position, score, confidence) to one row for each id."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions import text as T


def label(score: Column, confidence: Column) -> Column:
    return (
        F.when(confidence < 0.3, "uncertain").when(score < 0.35, "human").when(score > 0.65, "ai").when(confidence < 0.5, "uncertain").otherwise("mixed")
    )


def mean_score() -> Column:
    return F.coalesce(F.avg("score"), F.lit(0.5))


def mean_confidence() -> Column:
    return F.coalesce(F.avg("confidence"), F.lit(0.0))


def weighted_score(weights: dict[str, float] | None) -> Column:
    """Weighted mean, a detector without weight counting 1; all weights zero give 0.5."""
    if not weights:
        return mean_score()
    weight = F.lit(1.0)
    for name, value in weights.items():
        weight = F.when(F.col("detector") == name, F.lit(float(value))).otherwise(weight)
    return T.ratio(F.sum(F.col("score") * weight), F.sum(weight), 0.5)


def uncertainty_score() -> Column:
    """Mean weighted by confidence, halved below 0.6; no weight at all gives 0.5."""
    weight = F.when(F.col("confidence") >= 0.6, F.col("confidence")).otherwise(F.col("confidence") / 2)
    return T.ratio(F.sum(F.col("score") * weight), F.sum(weight), 0.5)


def combine(scores: DataFrame, strategy: str = "weighted_average", weights: dict[str, float] | None = None, id_col: str = "doc_id", *more: Column) -> DataFrame:
    """(id, score, confidence, label, n_detectors) and `more` aggregates; an unknown strategy is the plain mean."""
    weight = F.when(F.col("confidence") >= 0.6, F.col("confidence")).otherwise(F.col("confidence") / 2)
    by_strategy = {"weighted_average": weighted_score(weights), "uncertainty_aware": uncertainty_score()}
    confidence = mean_confidence()
    if strategy == "uncertainty_aware":
        confidence = F.when(F.sum(weight) == 0, 0.0).otherwise(confidence)
    combined = scores.groupBy(id_col).agg(
        by_strategy.get(strategy, mean_score()).alias("score"), confidence.alias("confidence"), F.count("*").alias("n_detectors"), *more
    )
    return combined.withColumn("label", label(F.col("score"), F.col("confidence")))


def stacking_vectors(scores: DataFrame, detectors: list[str], id_col: str = "doc_id") -> DataFrame:
    """One row for each id with columns score_<d> and confidence_<d>, null where a detector is missing."""
    columns = [
        F.max(F.when(F.col("detector") == d, F.col(c))).alias(f"{c}_{d}") for d in detectors for c in ("score", "confidence")
    ]
    return scores.groupBy(id_col).agg(*columns)


class Stacker:
    """Logistic regression on stacking vectors as an ML pipeline; rows with a missing feature are left out of training, with their labels."""

    def __init__(self, detectors: list[str], model: PipelineModel | None = None):
        self.detectors, self.model = detectors, model
        self.columns = [f"{c}_{d}" for d in detectors for c in ("score", "confidence")]

    def fit(self, scores: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Stacker:
        rows = stacking_vectors(scores, self.detectors, id_col).join(labels.select(id_col, "label"), id_col).dropna(subset=self.columns).persist()
        try:
            found = rows.agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes")).first()
            if found["n"] < 10 or found["classes"] < 2:
                raise ValueError("stacking needs ten texts and both classes")
            vectors = VectorAssembler(inputCols=self.columns, outputCol="stacked", handleInvalid="skip")
            regression = LogisticRegression(featuresCol="stacked", labelCol="label", regParam=1 / found["n"], standardization=False)
            self.model = Pipeline(stages=[vectors, regression]).fit(rows)
        finally:
            rows.unpersist()
        return self

    def predict(self, scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(id, score, confidence, label); rows with a missing feature get the plain mean."""
        stacked = self.model.transform(stacking_vectors(scores, self.detectors, id_col)).select(id_col, vector_to_array("probability")[1].alias("stacked_score"))
        plain = scores.groupBy(id_col).agg(mean_score().alias("mean"), mean_confidence().alias("confidence"))
        out = plain.join(stacked, id_col, "left").select(id_col, F.coalesce("stacked_score", "mean").alias("score"), "confidence")
        return out.withColumn("label", label(F.col("score"), F.col("confidence")))

    def save(self, folder: str) -> None:
        """The fitted pipeline, by its own writer, below a folder that all of the cluster can write."""
        if self.model is None:
            raise ValueError("the stacker is not fitted")
        self.model.write().overwrite().save(folder)

    @classmethod
    def load(cls, folder: str) -> Stacker:
        """A saved stacker; its detectors are those of the pipeline's columns."""
        model = PipelineModel.load(folder)
        return cls([c.removeprefix("score_") for c in model.stages[0].getInputCols() if c.startswith("score_")], model)


def brier_gram(scores: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(a, b, product, target, n): sums of score products of each two detectors and of score times label.

    One pass over the scores; the table has a row for each two detectors.
    """
    rows = scores.join(labels.select(id_col, "label"), id_col).groupBy(id_col, "label").agg(F.collect_list(F.struct("detector", "score")).alias("s"))
    each = rows.select("label", "s", F.explode("s").alias("a")).select("label", "a", F.explode("s").alias("b"))
    return each.groupBy(F.col("a.detector").alias("a"), F.col("b.detector").alias("b")).agg(
        F.sum(F.col("a.score") * F.col("b.score")).alias("product"), F.sum(F.col("a.score") * F.col("label")).alias("target"), F.count("*").alias("n")
    )


def optimal_weights(gram: DataFrame, steps: int = 2000, low: float = 0.01, high: float = 1.0) -> dict[str, float]:
    """Normalised weights of least Brier score, by projected gradient on the small table of brier_gram()."""
    rows = gram.collect()
    names = sorted({r["a"] for r in rows})
    place = {x: i for i, x in enumerate(names)}
    product, target = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in rows:
        product[place[r["a"]], place[r["b"]]] = r["product"] / r["n"]
        target[place[r["a"]]] = r["target"] / r["n"]
    w = np.full(len(names), 0.5)
    for _ in range(steps):
        total = w.sum()
        by_share = 2 * (product @ (w / total) - target)
        gradient = (by_share - by_share @ w / total) / total
        w = np.clip(w - 0.5 * gradient, low, high)
    return dict(zip(names, (w / w.sum()).tolist(), strict=True))


def confidence_interval(scores: DataFrame, id_col: str = "doc_id", level: float = 0.95) -> DataFrame:
    """(id, low, high) around the mean score: the sample deviation, z of 1.96 for 0.95 and 2.576 for all else."""
    z = 1.96 if level == 0.95 else 2.576
    half = F.when(F.count("score") > 1, z * F.stddev_samp("score") / F.sqrt(F.count("score")))
    middle = F.avg("score")
    one = F.count("score") == 1
    return scores.groupBy(id_col).agg(
        F.when(one, middle).otherwise(F.coalesce(middle - half, F.lit(0.0))).alias("low"), F.when(one, 0.0).otherwise(F.coalesce(middle + half, F.lit(0.0))).alias("high")
    )


def merged_features(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, position, feature, value) to (id, feature, value): the last position holds."""
    return rows.groupBy(id_col, "feature").agg(F.max_by("value", "position").alias("value"))


def top_features(rows: DataFrame, id_col: str = "doc_id", n: int = 20) -> DataFrame:
    """Rows (id, position, feature, value) to the n of each id with the largest absolute values; equals by position, then name."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.abs("value")).alias("order"), "position", "feature", "value")))
    top = rows.groupBy(id_col).agg(F.slice(ordered, 1, n).alias("top"))
    each = top.select(id_col, F.posexplode("top").alias("rank", "x"))
    return each.select(id_col, (F.col("rank") + 1).cast("bigint").alias("rank"), "x.feature", "x.value")
