"""Gradient-boosted stylometry: training with a small search, scoring, and per-row attributions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.operators import shapley
from penmark.operators.detectors import Context, Detector, ModelNotFoundError
from penmark.operators.search import Range, Trial, tuned


def assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features aligned by name; what a row lacks is 0."""
    filled = rows.select("*", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"__{c}") for c in features])
    return VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="x").transform(filled).drop(*(f"__{c}" for c in features))


def train(rows: DataFrame, features: Sequence[str], label_col: str = "label", depths: Sequence[int] = (3, 5), rounds: int = 20, folds: int = 5) -> GBTClassificationModel:
    """The best of a few depths by exact area under the curve over `folds` folds."""
    ready = assembled(rows, features).withColumn("y", F.col(label_col).cast("double")).persist()
    try:
        base = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, seed=42)
        grid = ParamGridBuilder().addGrid(base.maxDepth, list(depths)).build()
        evaluator = BinaryClassificationEvaluator(labelCol="y", numBins=0)
        return CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, seed=42).fit(ready).bestModel
    finally:
        ready.unpersist()


#: Where search() looks for the parameters of the trees.
SPACE = {
    "maxDepth": Range(2, 6, whole=True), "maxIter": Range(10, 60, whole=True), "stepSize": Range(0.02, 0.3, log=True),
    "subsamplingRate": Range(0.5, 1.0), "minInstancesPerNode": Range(1, 100, whole=True, log=True),
}


def search(
    rows: DataFrame, features: Sequence[str], label_col: str = "label", trials: int = 50, folds: int = 5, space: dict[str, Range] | None = None
) -> tuple[GBTClassificationModel, list[Trial]]:
    """The best of `trials` sequential trials by exact area under the curve over the folds, fitted on all rows, and the trials."""
    ready = assembled(rows, features).withColumn("y", F.col(label_col).cast("double")).withColumn("__key", F.to_json(F.struct(*features)))
    base = GBTClassifier(featuresCol="x", labelCol="y", seed=42)
    return tuned(base, ready, space or SPACE, BinaryClassificationEvaluator(labelCol="y", numBins=0), trials=trials, folds=folds, key="__key")


def predict(model: GBTClassificationModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """`rows` with score, the probability of label 1, and confidence."""
    scored = model.transform(assembled(rows, features)).withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
    return scored.withColumn("confidence", F.least(F.lit(1.0), 0.7 + 0.4 * F.abs(F.col("score") - 0.5)))


def save(model: GBTClassificationModel, features: Sequence[str], folder: str) -> None:
    """The model and the order of its features, below a folder that all of the cluster can write."""
    model.write().overwrite().save(f"{folder}/model")
    rows = list(enumerate(features))
    SparkSession.active().createDataFrame(rows, "place int, feature string").coalesce(1).write.mode("overwrite").json(f"{folder}/features")


def load(folder: str) -> tuple[GBTClassificationModel, list[str]]:
    try:
        rows = SparkSession.active().read.json(f"{folder}/features").collect()
        return GBTClassificationModel.load(f"{folder}/model"), [r["feature"] for r in sorted(rows, key=lambda r: r["place"])]
    except Exception as failure:
        raise ModelNotFoundError(f"no boosted model in {folder}") from failure


def detector(model: GBTClassificationModel, features: Sequence[str], made: Callable[[Column], dict[str, Column]] = X.stylometry) -> Detector:
    """The boosted model as a detector; `made` gives the features of a text column by name."""

    def score(units: DataFrame, id_col: str, context: Context) -> DataFrame:
        known = made(F.col("text"))
        rows = units.select(id_col, *[known[c].cast("double").alias(c) for c in features if c in known])
        missing = [F.lit(0.0).alias(c) for c in features if c not in known]
        return predict(model, rows.select("*", *missing), features).select(id_col, "score", "confidence", F.lit(None).cast("string").alias("error"))

    return Detector("boosted_stylometric", "fast", ("prose", "academic"), score)


def attributions(
    model: GBTClassificationModel, rows: DataFrame, features: Sequence[str], id_col: str = "doc_id", top: int = 10, background: DataFrame | None = None
) -> DataFrame:
    """(id, rank, feature, value): the `top` Shapley values of each row, of the margin that the trees sum up to.

    `background` (the rows themselves if null) says how often each side of a split is taken.
    """
    explained = shapley.explain(shapley.trees_of(model), rows, features, background=background, id_col=id_col)
    return shapley.ranked(explained, features, id_col, top)
