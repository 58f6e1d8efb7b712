"""Calibrated detectors: scaled features, logistic regression, k-fold isotonic or sigmoid calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.operators.metrics import hash_order


@dataclass
class Calibrator:
    """Means and population deviations of the features, and a base model with its calibrator for each fold."""

    features: list[str]
    centre: list[float]
    scale: list[float]
    method: str
    folds: list[tuple[LogisticRegressionModel, IsotonicRegressionModel | LogisticRegressionModel]]

    def _scaled(self, rows: DataFrame) -> DataFrame:
        columns = [((F.coalesce(F.col(c), F.lit(0.0)) - m) / (s or 1.0)).alias(f"__{c}") for c, m, s in zip(self.features, self.centre, self.scale, strict=True)]
        return VectorAssembler(inputCols=[f"__{c}" for c in self.features], outputCol="__x").transform(rows.select("*", *columns)).drop(*(f"__{c}" for c in self.features))

    def predict(self, rows: DataFrame) -> DataFrame:
        """`rows` with score, the mean calibrated probability of label 1 over the folds, and confidence, the larger of both classes'."""
        out, names = self._scaled(rows), []
        for i, (base, calibrator) in enumerate(self.folds):
            out = base.transform(out).withColumn("__margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")
            if self.method == "isotonic":
                out = calibrator.transform(out).withColumnRenamed("__calibrated", f"__p{i}")
            else:
                out = VectorAssembler(inputCols=["__margin"], outputCol="__m").transform(out)
                out = calibrator.transform(out).withColumn(f"__p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "__m")
            out = out.drop("__margin")
            names.append(f"__p{i}")
        score = sum((F.col(c) for c in names), F.lit(0.0)) / len(names)
        return out.withColumn("score", score).withColumn("confidence", F.greatest("score", 1 - F.col("score"))).drop("__x", *names)

    def save(self, folder: str) -> None:
        """Models and their description below a folder that all of the cluster can write."""
        spark = _session()
        for i, (base, calibrator) in enumerate(self.folds):
            base.write().overwrite().save(f"{folder}/fold={i}/base")
            calibrator.write().overwrite().save(f"{folder}/fold={i}/calibrator")
        rows = [(i, c, m, s, self.method, len(self.folds)) for i, (c, m, s) in enumerate(zip(self.features, self.centre, self.scale, strict=True))]
        spark.createDataFrame(rows, "place int, feature string, centre double, scale double, method string, folds int").coalesce(1).write.mode("overwrite").json(f"{folder}/features")

    @classmethod
    def load(cls, folder: str) -> Calibrator:
        rows = sorted(_session().read.json(f"{folder}/features").collect(), key=lambda r: r["place"])
        method = rows[0]["method"]
        kind = IsotonicRegressionModel if method == "isotonic" else LogisticRegressionModel
        folds = [(LogisticRegressionModel.load(f"{folder}/fold={i}/base"), kind.load(f"{folder}/fold={i}/calibrator")) for i in range(rows[0]["folds"])]
        return cls([r["feature"] for r in rows], [r["centre"] for r in rows], [r["scale"] for r in rows], method, folds)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def folds_for(counts: dict[int, int], wanted: int) -> int:
    """As many folds as the smaller class has rows, `wanted` at most; fewer than two are an error."""
    n = min(wanted, min(counts.values(), default=0)) if len(counts) > 1 else 0
    if n < 2:
        raise ValueError("calibration needs both classes, with two rows each at least")
    return n


def fit(rows: DataFrame, features: Sequence[str], *, label_col: str = "label", key: str = "doc_id", method: str = "isotonic", cv: int = 5) -> Calibrator:
    """Fits on rows with features and a label of 0 or 1.

    Folds deal each class out by hash of the key. In each fold the base model
    is fitted on the others and its margins are calibrated on the held-out one.
    """
    if method not in ("isotonic", "sigmoid"):
        raise ValueError(f"unknown method {method!r}")
    counts = {r[label_col]: r["count"] for r in rows.where(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    k = folds_for(counts, cv)
    moments = rows.agg(*[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(f"m_{c}") for c in features], *[F.stddev_pop(F.coalesce(F.col(c), F.lit(0.0))).alias(f"s_{c}") for c in features]).first()
    out = Calibrator(list(features), [moments[f"m_{c}"] for c in features], [moments[f"s_{c}"] for c in features], method, [])
    keyed = rows.where(F.col(label_col).isin(0, 1)).withColumn("__fold", F.pmod(hash_order(F.col(key).cast("long")), F.lit(k)))
    ready = out._scaled(keyed).select("__x", F.col(label_col).cast("double").alias("__label"), "__fold").persist()
    try:
        for i in range(k):
            train, held = ready.where(F.col("__fold") != i), ready.where(F.col("__fold") == i)
            if train.select("__label").distinct().count() < 2 or held.isEmpty():
                continue
            n = train.count()
            base = LogisticRegression(featuresCol="__x", labelCol="__label", regParam=1 / n, standardization=False).fit(train)
            margins = base.transform(held).select(vector_to_array("rawPrediction")[1].alias("__margin"), "__label")
            if method == "isotonic":
                calibrator = IsotonicRegression(featuresCol="__margin", labelCol="__label", predictionCol="__calibrated").fit(margins)
            else:
                one = VectorAssembler(inputCols=["__margin"], outputCol="__m").transform(margins)
                calibrator = LogisticRegression(featuresCol="__m", labelCol="__label").fit(one)
            out.folds.append((base, calibrator))
    finally:
        ready.unpersist()
    if not out.folds:
        raise ValueError("no fold has both classes")
    return out


def promotion_reasons(
    reports: DataFrame, *, min_auroc_gain: float = 0.01, max_f1_loss: float = 0.0, min_tpr_gain: float | None = None
) -> DataFrame:
    """Rows (detector, before, after) of metric structs with the reasons against promotion, and promoted: none."""
    gain, loss = F.col("after.auroc") - F.col("before.auroc"), F.col("before.f1") - F.col("after.f1")
    reasons = [
        F.when(gain < min_auroc_gain, F.format_string("AUROC rises by %.4f; %.4f is asked for", gain, F.lit(min_auroc_gain))),
        F.when(loss > max_f1_loss, F.format_string("F1 falls by %.4f; %.4f is allowed", loss, F.lit(max_f1_loss))),
    ]
    if min_tpr_gain is not None:
        rise = F.col("after.tpr_at_1fpr") - F.col("before.tpr_at_1fpr")
        small = F.when(rise < min_tpr_gain, F.format_string("TPR at 1%% FPR rises by %.4f; %.4f is asked for", rise, F.lit(min_tpr_gain)))
        reasons.append(F.when(rise.isNull(), F.lit("TPR at 1% FPR is not known for both")).otherwise(small))
    return reports.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("promoted", F.size("reasons") == 0)


def artifact_path(folder: str, detector: str, dataset: str, aliases: Sequence[str] = ()) -> str:
    """Where a detector's calibration for a dataset belongs: the last alias names it, else the detector."""
    name = aliases[-1] if aliases else detector
    return str(PurePosixPath(folder) / f"{name}_{dataset}")
