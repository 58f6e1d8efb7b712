import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.functions import text as T
from penmark.operators import calibration, detectors, ensemble, external, facade, grains, metrics
from penmark.sources import config, datasets, reports
from penmark.streaming import monitor


def rows(spark, data):
    return spark.createDataFrame(data, "label int, score double")


def test_golden_metrics(spark):
    df = rows(spark, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)])
    points = metrics.curve(df)
    assert metrics.auroc(points).first()[0] == 1.0
    assert metrics.tpr_at_fpr(points, 0.05).first()[0] == 1.0
    assert metrics.auroc(metrics.curve(rows(spark, [(0, 0.5), (1, 0.5), (1, 0.5)]))).first()[0] == 0.5
    assert metrics.auroc(metrics.curve(rows(spark, [(1, 0.5), (1, 0.7)]))).first()[0] == 0.5
    c = metrics.confusion(rows(spark, [(0, 0.1), (1, 0.9), (1, 0.8), (1, 0.2)])).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"], c["accuracy"], c["precision"]) == (1, 0, 1, 2, 0.75, 1.0)
    assert metrics.confusion(rows(spark, [(2, 0.9)])).first()["tp"] == 0


def test_ranking_metrics_against_literal_definitions(spark):
    rng = np.random.default_rng(3)
    label, score = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    points = metrics.curve(rows(spark, [(int(a), float(b)) for a, b in zip(label, score, strict=True)]))
    p, n = score[label == 1], score[label == 0]
    wanted = np.mean((p[:, None] > n) + 0.5 * (p[:, None] == n))
    assert math.isclose(metrics.auroc(points).first()[0], wanted)
    curve = [(0.0, 0.0)] + [(np.mean(n >= t), np.mean(p >= t)) for t in sorted(set(score), reverse=True)]
    assert math.isclose(metrics.tpr_at_fpr(points, 0.3).first()[0], max(t for f, t in curve if f <= 0.3))
    last = max(i for i, (_, t) in enumerate(curve) if t <= 0.9)
    (f0, t0), (f1, t1) = curve[last], curve[min(last + 1, len(curve) - 1)]
    assert math.isclose(metrics.fpr_at_tpr(points, 0.9).first()[0], f0 + (0.9 - t0) * (f1 - f0) / (t1 - t0) if t1 > t0 else f0)


def test_ensemble_strategies_and_label(spark):
    long = spark.createDataFrame([(1, "a", 0, 0.7, 0.8), (1, "b", 1, 0.5, 0.0), (2, "a", 0, 0.5, 0.0)], "doc_id int, detector string, position int, score double, confidence double")
    by = {r["doc_id"]: r for r in ensemble.combine(long, "mean").collect()}
    assert math.isclose(by[1]["score"], 0.6)
    unsure = {r["doc_id"]: r for r in ensemble.combine(long, "uncertainty_aware").collect()}
    assert math.isclose(unsure[1]["score"], 0.7) and (unsure[2]["score"], unsure[2]["confidence"]) == (0.5, 0.0)
    weighted = {r["doc_id"]: r for r in ensemble.combine(long, "weighted_average", {"a": 3.0}).collect()}
    assert math.isclose(weighted[1]["score"], 0.65)
    none = {r["doc_id"]: r for r in ensemble.combine(long, "weighted_average", {"a": 0.0, "b": 0.0}).collect()}
    assert none[1]["score"] == 0.5
    interval = {r["doc_id"]: r for r in ensemble.confidence_interval(long).collect()}
    assert interval[1]["low"] < 0.6 < interval[1]["high"] and (interval[2]["low"], interval[2]["high"]) == (0.5, 0.0)


def test_optimal_weights_prefer_the_detector_that_is_right(spark):
    data = [(i, d, 0, float(i % 2) if d == "good" else 0.5, 1.0) for i in range(20) for d in ("good", "bad")]
    long = spark.createDataFrame(data, "doc_id int, detector string, position int, score double, confidence double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id int, label int")
    weights = ensemble.optimal_weights(ensemble.brier_gram(long, labels))
    assert weights["good"] > 0.9


def test_self_bleu_of_equal_and_different_paragraphs(spark):
    df = spark.createDataFrame([(1, "a b c d e f\n\na b c d e f"), (2, "a b c d e\n\nv w x y z"), (3, "a b c d e")], "doc_id int, text string")
    got = {r["doc_id"]: r["self_bleu"] for r in grains.self_bleu(df, "doc_id").collect()}
    assert math.isclose(got[1], 1.0) and got[2] == 0.0 and got[3] == 0.0


def test_code_detector(spark):
    source = "def f(data):\n    for i in data:\n        if i:\n            while True:\n                pass\n    return data\n"
    df = spark.createDataFrame([(1, source), (2, "def broken(:\n"), (3, "plain words")], "doc_id int, text string")
    parsed = {r["doc_id"]: (r["function_count"], r["max_function_depth"]) for r in detectors.syntax_features(df, "doc_id").collect()}
    assert parsed == {1: (1.0, 3.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    out = {r["doc_id"]: r for r in detectors.default_catalog().get("code").score(df, "doc_id", detectors.Context()).collect()}
    assert (out[2]["score"], out[2]["confidence"], out[2]["error"]) == (0.5, 0.3, "no function could be parsed")
    assert out[1]["error"] is None


def test_facade_gates_short_texts_and_survives_edge_strings(spark):
    long = " ".join(["The quick brown fox jumps over the lazy dog."] * 40)
    df = spark.createDataFrame([(1, ""), (2, "a"), (3, "Hi!"), (4, long), (5, None)], "doc_id int, text string")
    context = detectors.Context(grains.reference_frequencies(df))
    found = facade.detect(df, detectors.default_catalog().select(["repetition", "stylometric", "nothing"]), context)
    out = {r["doc_id"]: r for r in found.collect()}
    assert len(out) == 5 and all(out[i]["label"] == "uncertain" and out[i]["score"] == 0.5 and out[i]["confidence"] == 0.3 for i in (1, 2, 3, 5))
    assert out[4]["n_chunks"] == 1 + math.ceil((len(long) - 512) / 384) and out[4]["score"] > 0.5


def test_sentence_scores(spark):
    heat = F.expr("array(named_struct('token','a','score',0.1D), named_struct('token','b','score',0.3D), named_struct('token','c','score',0.8D))")
    bounds = F.expr("array(named_struct('start',0,'end',2), named_struct('start',2,'end',3), named_struct('start',9,'end',10))")
    got = spark.range(1).select(facade.sentence_scores(heat, bounds).alias("s")).first()["s"]
    assert [round(x, 6) for x in got] == [0.2, 0.8, 0.5]


def test_importance(spark):
    got = spark.range(1).select(facade.importance(F.expr("map('a', 0.1D, 'b', -0.5D, 'c', 0.3D)"), 2).alias("x")).first()["x"]
    assert [r["feature"] for r in got] == ["b", "c"]


def test_external_replies(spark):
    df = spark.createDataFrame([("x {\"score\": 0.9, \"confidence\": \"high\"} y",), ("no json",)], "reply string")
    got = [(r["p"]["score"], r["p"]["confidence"]) for r in df.select(external.json_reply(F.col("reply")).alias("p")).collect()]
    assert got == [(0.9, 0.9), (0.5, 0.0)]
    assert spark.range(1).select(external.rating_score(F.lit("8")).alias("x")).first()["x"] == 0.8
    asked = external.asked(spark.createDataFrame([(1, "p")], "doc_id int, prompt string"), lambda prompts: [f"re: {p}" for p in prompts])
    assert asked.first()["reply"] == "re: p"


def test_missing_model_is_an_error_result(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id int, text string")
    r = detectors.score_units(df, [detectors.default_catalog().get("classifier")], detectors.Context()).first()
    assert (r["score"], r["confidence"]) == (0.5, 0.0) and "not available" in r["error"]


def test_catalog():
    catalog = detectors.default_catalog()
    assert len(catalog.select()) == 22
    assert {d.name for d in catalog.select(domain="code")} >= {"code", "classifier_radar"}
    assert [d.name for d in catalog.select(["entropy", "unknown"])] == ["entropy"]
    with pytest.raises(KeyError):
        catalog.get("unknown")


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_learns_a_step_and_can_be_saved(spark, tmp_path, method):
    df = spark.createDataFrame([(i, float(i % 10) / 10, int(i % 10 >= 5)) for i in range(200)], "doc_id int, f double, label int")
    fitted = calibration.fit(df, ["f"], method=method, cv=3)
    fitted.save(str(tmp_path / "model"))
    for model in (fitted, calibration.Calibrator.load(str(tmp_path / "model"))):
        got = model.predict(df)
        assert metrics.auroc(metrics.curve(got)).first()[0] == 1.0
    with pytest.raises(ValueError, match="both classes"):
        calibration.fit(df.where("label = 1"), ["f"])


def test_promotion(spark, tmp_path):
    summary = {"dataset": "d", "results": {"x": {"before": {"auroc": 0.6, "f1": 0.5}, "after": {"auroc": 0.8, "f1": 0.6}}, "y": {"before": {"auroc": 0.6, "f1": 0.5}, "after": {"auroc": 0.6, "f1": 0.4}}}}
    path = tmp_path / "summary.json"
    path.write_text(json.dumps(summary, indent=1))
    decided = calibration.promotion_reasons(datasets.promotion_summary(spark, str(path)))
    got = {r["detector"]: (r["promoted"], len(r["reasons"])) for r in decided.collect()}
    assert got == {"x": (True, 0), "y": (False, 2)}
    yaml, decisions = reports.promoted_config(decided, {"x": "models/x"})
    assert "x: models/x" in yaml and list(json.loads(decisions)["rejected"]) == ["y"]


def test_config(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("penmark:\n  min_text_length: 99\n  ensemble:\n    strategy: mean\n  unknown: 1\n")
    got = config.resolve(path, {"ensemble": {"weights": {"a": 2.0}}})
    assert (got.min_text_length, got.ensemble.strategy, got.ensemble.weights) == (99, "mean", {"a": 2.0})
    (tmp_path / "c.txt").write_text("x")
    with pytest.raises(ValueError):
        config.load(tmp_path / "c.txt")


def test_datasets(spark, tmp_path):
    raw = spark.createDataFrame([("t1", "human", "news"), ("t2", "gpt", None), ("", "gpt", "x"), ("t3", None, "x")], "generation string, model string, domain string")
    raw.write.parquet(str(tmp_path / "raid"))
    known = datasets.Datasets()
    from dataclasses import replace

    known.register(replace(known.get("raid"), path=str(tmp_path / "raid")))
    got = {r["text"]: (r["label"], dict(r["meta"])) for r in datasets.sample(spark, known.get("raid"), 10, str(tmp_path / "cache")).collect()}
    assert got == {"t1": (0, {"domain": "news"}), "t2": (1, {})}
    with pytest.raises(ValueError, match="unknown dataset"):
        known.get("none")
    tagged = datasets.tagged(spark.range(5), "id", ["en", "de"], each=2)
    assert {r["id"]: r["language"] for r in tagged.collect()} == {0: "en", 1: "de", 2: "en", 3: "de", 4: "unknown"}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "word " * 60), (2, "short")], "doc_id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = monitor.scored_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r["doc_id"], r["score"], r["label"])
    assert sorted(map(key, spark.table("scored").collect())) == sorted(map(key, monitor.scored_stream(df).collect()))


def test_split_is_stratified(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id bigint, label int")
    got = {(r["label"], r["split"]): r["count"] for r in metrics.split(df, "doc_id").groupBy("label", "split").count().collect()}
    assert all(abs(got[(label, "test")] - 100) <= 2 for label in (0, 1))
