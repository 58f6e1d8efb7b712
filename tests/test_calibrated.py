"""Calibrated, boosted, external and failing detectors, chunk details, the harness and reports."""

import json

import pytest
from pyspark.sql import functions as F

from penmark import cli
from penmark.functions import features as X
from penmark.operators import boosting, calibrated, detectors, external, facade, grains
from penmark.operators.detectors import Context, Detector, RowWise, result
from penmark.plans.harness import Harness
from penmark.sources import datasets, reports

HUMAN = "Rain fell on {0} roofs while an old clerk counted {1} boxes of tea and wrote home about it. Nobody answered number {0} for weeks."
MACHINE = "the model is good and the model is good and the model is good and the model is good in case {0} and {1}."


@pytest.fixture(scope="module")
def corpus(spark):
    words = "one two three four five six seven eight nine ten".split()
    rows = [(i, (HUMAN, MACHINE)[i % 2].format(words[i % 10], words[i // 10 % 10]), i % 2) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(2).persist()


@pytest.fixture(scope="module")
def context(corpus):
    return Context(grains.reference_frequencies(corpus))


def test_train_saves_and_is_found(spark, corpus, context, tmp_path):
    catalog = detectors.default_catalog()
    fitted, report = calibrated.train(corpus, ["repetition", "academic"], catalog, context, folder=str(tmp_path), cv=2, method="sigmoid")
    assert list(fitted) == ["repetition"]
    row = report.first()
    assert row["after"]["auroc"] >= row["before"]["auroc"] - 1e-9 and row["delta"]["auroc"] == pytest.approx(row["after"]["auroc"] - row["before"]["auroc"])
    text, table = reports.calibration_results(report, "own")
    assert json.loads(text)["results"]["repetition"]["after"]["num_samples"] > 0 and "repetition" in table
    built = calibrated.build(spark, ["repetition", "unheard"], catalog, folder=str(tmp_path))
    assert [d.name for d in built] == ["repetition"]
    plain = detectors.score_units(corpus, catalog.select(["repetition"]), context).select("doc_id", "score").collect()
    bound = detectors.score_units(corpus, built, context).select("doc_id", "score").collect()
    assert sorted(bound) != sorted(plain) and len(bound) == 60
    with pytest.raises(detectors.ModelNotFoundError):
        calibrated.loaded(str(tmp_path / "nothing"))
    assert calibrated.discovered(spark, str(tmp_path / "nothing"), ["repetition"]) is None


def test_boosted_detector_survives_saving(spark, corpus, context, tmp_path):
    made = X.stylometry(F.col("text"))
    rows = corpus.select("label", *[c.cast("double").alias(n) for n, c in made.items()])
    model = boosting.train(rows, list(made), depths=(2,), rounds=2, folds=2)
    boosting.save(model, list(made), str(tmp_path / "b"))
    scores = [
        {r["doc_id"]: r["score"] for r in detectors.score_units(corpus, [boosting.detector(*m)], context).collect()} for m in ((model, list(made)), boosting.load(str(tmp_path / "b")))
    ]
    assert scores[0] == scores[1]
    assert min(scores[0][i] for i in range(1, 60, 2)) > max(scores[0][i] for i in range(0, 60, 2))


def test_external_detectors(spark, corpus, context):
    own = [
        external.classifier("classifier", lambda texts: [json.dumps({"label": "Human", "probability": 0.9}) if "Rain" in t else None for t in texts]),
        external.logprob(lambda texts: ["-2" if "Rain" in t else "none" for t in texts]),
        external.perturbation(lambda texts: ["9" if len(t) > 5 else "1" for t in texts], lambda texts: [json.dumps(["a", "b"]) for _ in texts]),
        external.reasoning(lambda prompts: ['so: {"score": 0.9, "confidence": "high", "reasoning": "r"}' for _ in prompts]),
    ]
    out = {(r["doc_id"], r["detector"]): (round(r["score"], 6), r["confidence"], r["error"]) for r in detectors.score_units(corpus.where("doc_id < 2"), own, context).collect()}
    assert out[0, "classifier"] == (0.1, 1.0, None) and out[1, "classifier"] == (0.5, 0.0, "no reply")
    assert out[0, "llm_logprob"] == (0.8, 0.7, None) and out[1, "llm_logprob"] == (0.5, 0.3, None)
    assert out[0, "llm_perturbation"] == (0.8, 0.7, None) and out[0, "llm_reasoning"] == (0.9, 0.9, None)


def test_failures_stay_with_their_detector(corpus, context):
    def broken(units, id_col, context):
        return units.select(id_col, F.raise_error(F.lit("broken")).cast("double").alias("score"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("error"))

    def unplanned(units, id_col, context):
        raise KeyError("no reference")

    def unset(units, id_col, context):
        raise detectors.ModelNotFoundError("no model")

    fine = Detector("fine", "fast", ("prose",), RowWise(lambda text, words, t: result(F.size(words) / 100, F.lit(0.9))))
    listed = [fine, Detector("broken", "fast", ("prose",), broken), Detector("unplanned", "fast", ("prose",), unplanned), Detector("absent", "fast", ("prose",))]
    out = {r["detector"]: r for r in detectors.score_units(corpus.where("doc_id = 1"), listed, context, isolate=True).collect()}
    assert out["fine"]["error"] is None and out["fine"]["score"] > 0
    assert all((out[n]["score"], out[n]["confidence"]) == (0.5, 0.0) and out[n]["error"] for n in ("broken", "unplanned", "absent"))
    with pytest.raises(detectors.DetectorInitError):
        detectors.score_units(corpus, [Detector("unset", "fast", ("prose",), unset)], context)
    again = Detector("fine", "fast", ("prose",), RowWise(lambda text, words, t: result(F.lit(0.25), F.lit(0.9))))
    assert [r["score"] for r in detectors.score_units(corpus.where("doc_id = 1"), [fine, again], context).collect()] == [0.25]


def test_ensemble_of_one_and_of_none(corpus, context):
    fine = Detector("fine", "fast", ("prose",), RowWise(lambda text, words, t: result(F.lit(0.8), F.lit(0.9))))
    both = detectors.combined("both", [fine, Detector("absent", "fast", ("prose",))], "uncertainty_aware")
    assert [r["score"] for r in detectors.score_units(corpus.where("doc_id = 1"), [both], context).collect()] == [0.8]
    assert detectors.score_units(corpus, [], context).count() == 0
    rows = facade.detect(corpus.where("doc_id < 2"), [], context, least=5).collect()
    assert {(r["score"], r["confidence"], r["label"]) for r in rows} == {(0.5, 0.0, "uncertain")}


def test_chunk_details(spark):
    ready = spark.createDataFrame([(1, "a b. c d e."), (2, "x y.")], "doc_id long, text string")
    token = "array<struct<token:string,score:double>>"
    parts = spark.createDataFrame(
        [((1, 1), 0, [("e", 1.0)]), ((1, 0), 1, [("c", 0.5), ("d", 0.7)]), ((1, 0), 0, [("a", 0.0), ("b", 0.2)])],
        f"unit struct<doc_id:long,chunk_index:int>, position int, heatmap {token}",
    )
    out = {r["doc_id"]: r for r in facade.heatmaps(ready, parts, most=3).collect()}
    assert [t["token"] for t in out[1]["heatmap"]] == ["a", "b", "c"]
    assert out[1]["sentences"] == pytest.approx([0.1, 2.2 / 3])
    assert [t["score"] for t in out[2]["heatmap"]] == [0.5, 0.5]
    features = spark.createDataFrame(
        [((1, 1), 1, "p", 9.0), ((1, 0), 2, "r", 2.0), ((1, 0), 1, "q", 3.0)], "unit struct<doc_id:long,chunk_index:int>, rank long, feature string, value double"
    )
    assert [f["feature"] for f in facade.joined_features(features, most=2).first()["features"]] == ["q", "r"]


def test_harness_skips_what_does_not_load(spark, corpus, context, tmp_path):
    corpus.select("text", F.col("label").cast("string").alias("kind")).write.json(str(tmp_path / "own"))
    known = datasets.Datasets([datasets.Dataset("own", path=str(tmp_path / "own"), format="json", text_field="text", label_field="kind"), datasets.Dataset("gone", path=str(tmp_path / "gone"), text_field="t", label_field="l")])
    harness = Harness(spark, known)
    rows = harness.run(detectors.default_catalog().select(["repetition"]), context).collect()
    assert [(r["dataset"], r["detector"], r["num_samples"]) for r in rows] == [("own", "repetition", 60)] and list(harness.skipped) == ["gone"] and rows[0]["seconds"] >= 0 == rows[0]["errors"]
    rows = harness.run([detectors.Detector("broken", "fast", ("prose",)), *detectors.default_catalog().select(["entropy"])], context, ["own"]).collect()
    assert {r["detector"]: r["errors"] for r in rows} == {"broken": 60, "entropy": 0} and all(r["seconds"] >= 0 for r in rows)
    with pytest.raises(ValueError):
        harness.load("unheard")


def test_command_line_calibrates(spark, corpus, tmp_path):
    corpus.select("text", "label").coalesce(1).write.json(str(tmp_path / "c"))
    common = ["--dataset", str(tmp_path / "c"), "--folder", str(tmp_path / "m"), "--detector", "stylometric"]
    assert "stylometric" in cli.main(["calibrate", *common], spark)
    assert "- stylometric: AUROC" in cli.main(["calibration-evaluate", *common], spark)
