"""Detectors with a calibration: their features, binding, discovery of saved models, and reports before and after."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.functions import text as T
from penmark.operators import calibration, grains, lm, metrics
from penmark.operators.calibration import Calibrator
from penmark.operators.detectors import Catalog, Context, Detector, ModelNotFoundError, score_units

#: Set to any value, keeps build() from looking for saved calibrations.
NO_DISCOVERY = "PENMARK_NO_CALIBRATION"

#: (units, id_col, context) to a row of the named features for each unit that has any.
Features = Callable[[DataFrame, str, Context], DataFrame]


def _repetition(units: DataFrame, id_col: str, context: Context) -> DataFrame:
    f = X.repetition(F.col("words"))
    return units.select(id_col, T.words(F.col("text")).alias("words")).select(id_col, *[f[c].alias(c) for c in ("ngram_3_repetition", "ngram_4_repetition")])


def _stylometric(units: DataFrame, id_col: str, context: Context) -> DataFrame:
    words = units.select(id_col, "text", T.words(F.col("text")).alias("words"))
    counts = words.select(id_col, "text", "words", T.run_lengths(F.col("words")).alias("counts"))
    f = X.richness(F.col("words"), F.col("counts")) | {"std_sentence_length": X.sentence_lengths(F.col("text"))["std_sentence_length"]}
    return counts.select(id_col, *[c.alias(name) for name, c in f.items()])


#: The calibrated detectors' features, in the order of their models.
FEATURES: dict[str, tuple[tuple[str, ...], Features]] = {
    "entropy": (("kl_divergence",), lambda units, key, context: grains.kl_divergence(units, context.reference, key)),
    "repetition": (("ngram_3_repetition", "ngram_4_repetition"), _repetition),
    "stylometric": (("std_sentence_length", "ttr", "yules_k", "herdans_c", "hapax_ratio"), _stylometric),
    "surprisal": (
        ("surprisal_variance", "surprisal_autocorr", "surprisal_burstiness", "surprisal_entropy", "surprisal_trend", "mean_surprisal"),
        lambda units, key, context: lm.surprisal_stats(lm.token_surprisals(units, context.model, key), key),
    ),
    "burstiness": (("burstiness_cv",), lambda units, key, context: lm.sentence_burstiness(units, context.model, key)),
    "perplexity": (
        ("mean_perplexity", "perplexity_std"), lambda units, key, context: lm.windowed_perplexity(lm.token_surprisals(units, context.model, key), key),
    ),
    "curvature": (("curvature",), lambda units, key, context: lm.curvature(units, context.model, key)),
}


def feature_rows(detector: str, units: DataFrame, context: Context, id_col: str = "doc_id") -> DataFrame:
    """A detector's features of every unit; null where it has none. A detector without features is an error."""
    if detector not in FEATURES:
        raise ValueError(f"{detector!r} has no features to calibrate")
    names, made = FEATURES[detector]
    return units.select(id_col).join(made(units, id_col, context).select(id_col, *names), id_col, "left")


def bound(detector: Detector, calibrator: Calibrator) -> Detector:
    """The detector scoring by its calibration; a unit without features keeps the heuristic result."""

    def score(units: DataFrame, id_col: str, context: Context) -> DataFrame:
        rows = feature_rows(detector.name, units, context, id_col)
        none = F.coalesce(*[F.col(c).cast("double") for c in calibrator.features]).isNull()
        predicted = calibrator.predict(rows.withColumn("__none", none)).select(F.col(id_col).alias("__id"), "__none", F.col("score").alias("__s"), F.col("confidence").alias("__c"))
        both = detector.score(units, id_col, context).join(predicted, F.col(id_col) == F.col("__id"))
        heuristic = F.col("__none") | F.col("error").isNotNull()
        return both.select(id_col, F.when(heuristic, F.col("score")).otherwise(F.col("__s")).alias("score"), F.when(heuristic, F.col("confidence")).otherwise(F.col("__c")).alias("confidence"), "error")

    return replace(detector, score=score)


def discovered(spark, folder: str, names: Sequence[str]) -> str | None:
    """The newest saved calibration below `folder` that is named by one of the names, or by one and `_` and more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path):
        return None
    found = [(s.getModificationTime(), s.getPath().toString(), s.getPath().getName()) for s in files.listStatus(path) if s.isDirectory()]
    own = [(at, where) for at, where, name in found if any(name == n or name.startswith(f"{n}_") for n in names)]
    return max(own)[1] if own else None


def loaded(folder: str) -> Calibrator:
    try:
        return Calibrator.load(folder)
    except Exception as failure:
        raise ModelNotFoundError(f"no calibration in {folder}") from failure


def build(spark, names: Sequence[str], catalog: Catalog, *, paths: Mapping[str, str] | None = None, folder: str = "calibration_models") -> list[Detector]:
    """The named detectors, each with the calibration that `paths` names or that is found in `folder`; unknown names are left out."""
    out = []
    for d in catalog.select(names):
        where = (paths or {}).get(d.name)
        if where is None and not os.environ.get(NO_DISCOVERY) and d.name in FEATURES:
            where = discovered(spark, folder, [d.name])
        out.append(bound(d, loaded(where)) if where else d)
    return out


def measured(rows: DataFrame, detectors: Sequence[Detector], context: Context, id_col: str = "doc_id", label_col: str = "label") -> DataFrame:
    """The metric bundle of each detector over labelled texts, with errors and seconds; error results count with their 0.5.

    How many results are errors, and the seconds from a detector's first result
    to its last over all tasks, are summed up with the metrics.
    """
    now = F.expr("CAST(java_method('java.lang.System', 'currentTimeMillis') AS BIGINT)")
    scores = score_units(rows, detectors, context, id_col).withColumn("at", now)
    judged = scores.join(rows.select(id_col, F.col(label_col).alias("label")), id_col).select("detector", "label", "score", "error", "at").persist()
    try:
        more = (F.count("error").alias("errors"), ((F.max("at") - F.min("at")) / 1000).alias("seconds"))
        bundle = metrics.bundle(judged, ["detector"], 0.5, *more)
        return rows.sparkSession.createDataFrame(bundle.collect(), bundle.schema)  # a row for each detector
    finally:
        judged.unpersist()


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(detector, before, after, delta) of two tables of measured(); delta has the differences of the ranking metrics and of F1."""
    kept = [c for c in before.columns if c not in ("detector", "errors", "seconds")]
    one, two = before.select("detector", F.struct(*kept).alias("before")), after.select("detector", F.struct(*kept).alias("after"))
    changes = [(F.col(f"after.{c}") - F.col(f"before.{c}")).alias(c) for c in ("auroc", "average_precision", "f1", "tpr_at_1fpr")]
    return one.join(two, "detector").withColumn("delta", F.struct(*changes))


def compare(test: DataFrame, pairs: Mapping[str, Calibrator], catalog: Catalog, context: Context, id_col: str = "doc_id") -> DataFrame:
    """before_after() of the named detectors with and without their calibrations over one labelled table."""
    plain = catalog.select(list(pairs))
    return before_after(measured(test, plain, context, id_col), measured(test, [bound(d, pairs[d.name]) for d in plain], context, id_col))


def train(
    rows: DataFrame, names: Sequence[str], catalog: Catalog, context: Context, *, folder: str | None = None, dataset: str = "calibration",
    id_col: str = "doc_id", method: str = "isotonic", cv: int = 5, test_share: float = 0.2,
) -> tuple[dict[str, Calibrator], DataFrame]:
    """Fits the named detectors on the train split, saves them, and reports before and after on the test split.

    The split is that of metrics.split(), by class and hash. Names without
    features are left out; with none left it is an error.
    """
    split = metrics.split(rows, id_col, test_share=test_share)
    fitted = {}
    for name in names:
        if name in FEATURES and catalog.select([name]):
            part = split.where("split = 'train'")
            features = feature_rows(name, part, context, id_col).join(part.select(id_col, "label"), id_col)
            fitted[name] = calibration.fit(features, FEATURES[name][0], key=id_col, method=method, cv=cv)
            if folder:
                fitted[name].save(calibration.artifact_path(folder, name, dataset))
    if not fitted:
        raise ValueError("none of these detectors can be calibrated")
    return fitted, compare(split.where("split = 'test'"), fitted, catalog, context, id_col)
