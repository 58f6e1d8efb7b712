"""Composed results, errors of single texts, saved references and stackers, the command line with a reference."""

import json

import pytest
from pyspark.sql import functions as F

from penmark import cli
from penmark.operators import detectors, ensemble, facade
from penmark.operators.attribution import NgramScorer, heatmap
from penmark.operators.detectors import Context, Detector, DetectorError, PerText
from penmark.operators.grains import chunked
from penmark.sources import contexts

LONG = " ".join(f"The number {i} stands in this row. It was written by hand, and then it was read." for i in range(20))
DULL = " ".join("The model is good and the model is good and the model is good." for _ in range(20))


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, LONG), (2, DULL), (3, "Too short."), (4, None), (5, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("features", F.lit("clash")).withColumn("own", F.lit("clash"))


@pytest.fixture(scope="module")
def context(texts):
    return contexts.learnt(texts.where("doc_id = 1"))


def test_composed_results_agree_with_their_parts(spark, texts, context):
    chosen = [*detectors.default_catalog().select(["repetition", "stylometric", "entropy"]), Detector("classifier", "slow", ("prose",))]
    found = {r["doc_id"]: r for r in facade.results(texts, chosen, context, strategy="mean").collect()}
    plain = {r["doc_id"]: r for r in facade.detect(texts, chosen, context, strategy="mean").collect()}
    assert len(found) == 5
    for i, r in found.items():
        assert [r[c] for c in ("score", "confidence", "label", "n_chunks")] == pytest.approx([plain[i][c] for c in ("score", "confidence", "label", "n_chunks")])
    ready = facade.prepared(texts)
    units = chunked(ready.where(~F.col("short"))).select(F.struct("doc_id", "chunk_index").alias("unit"), "text")
    for m in facade.detector_means(detectors.score_units(units, chosen, context, "unit")).collect():
        own = found[m["doc_id"]]["detectors"][m["detector"]]
        assert [own["score"], own["confidence"], own["error"]] == pytest.approx([m["score"], m["confidence"], m["error"]])
    assert set(found[1]["detectors"]) == {"repetition", "stylometric", "entropy", "classifier"} and found[1]["detectors"]["classifier"]["error"]
    assert len(found[1]["top_features"]) == 20 and abs(found[1]["top_features"][0]["importance"]) >= abs(found[1]["top_features"][1]["importance"])
    assert len(found[1]["heatmap"]) == 200 and len(found[1]["sentences"]) == 40 and "ttr" in found[1]["features"]
    short = found[3]
    assert (short["score"], short["label"], short["confidence"], short["n_chunks"], short["detectors"]) == (0.5, "uncertain", 0.3, 0, None)
    assert [t["token"] for t in short["heatmap"]] == ["Too", "short."]
    assert facade.results(texts.limit(0), chosen, context).count() == 0


def test_results_with_attributed_tokens(spark, texts, context):
    labelled = texts.where("doc_id < 3").withColumn("label", (F.col("doc_id") == 2).cast("int"))
    units = chunked(facade.prepared(texts).where("NOT short")).select(F.struct("doc_id", "chunk_index").alias("unit"), "text")
    heat = heatmap(NgramScorer.fit(labelled).attributions(units, "unit"), "unit").withColumn("position", F.lit(0))
    r = facade.results(texts.where("doc_id = 2"), detectors.default_catalog().select(["repetition"]), context, heat=heat).first()
    assert len({t["score"] for t in r["heatmap"]}) > 3


def test_one_poisoned_text_of_many(spark):
    def outcome(text):
        if "poison" in text:
            raise RuntimeError("cannot read this")
        return len(text) / 1000, 0.9

    body = " ".join("Some words of a text that is long enough to be scored." for _ in range(15))
    rows = spark.range(10_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 4321, F.lit(body + " poison.")).otherwise(F.lit(body)).alias("text")).repartition(4)
    own = Detector("own", "fast", ("prose",), PerText(outcome))
    errors = detectors.score_units(rows, [own], Context()).where("error IS NOT NULL").collect()
    assert [(r["doc_id"], r["score"], r["confidence"], r["error"]) for r in errors] == [(4321, 0.5, 0.0, "RuntimeError: cannot read this")]
    found = facade.detect(rows, [own], Context())
    assert found.count() == 10_000 and found.where("confidence > 0.89").count() == 9999
    assert 0 < found.where("doc_id = 4321").first()["confidence"] < 0.89  # one of its two chunks is poisoned


def test_saved_stacker_scores_alike(spark, tmp_path):
    rows = [(i, d, p, ((i * 7 + p) % 10) / 10, 0.5 + (i % 3) / 10) for i in range(40) for p, d in enumerate(("a", "b")) if (i, d) != (5, "b")]
    scores = spark.createDataFrame(rows, "doc_id long, detector string, position int, score double, confidence double")
    labels = spark.createDataFrame([(i, int((i * 7) % 10 > 4)) for i in range(40)], "doc_id long, label int")
    with pytest.raises(ValueError):
        ensemble.Stacker(["a"]).save(str(tmp_path / "none"))
    fitted = ensemble.Stacker(["a", "b"]).fit(scores, labels)
    fitted.save(str(tmp_path / "stacker"))
    again = ensemble.Stacker.load(str(tmp_path / "stacker"))
    assert again.detectors == ["a", "b"]
    first, second = (sorted(map(tuple, s.predict(scores).collect())) for s in (fitted, again))
    assert first == second and len(first) == 40


def test_saved_reference(spark, texts, context, tmp_path):
    contexts.save(context, str(tmp_path / "reference"))
    again = contexts.load(spark, str(tmp_path / "reference"))
    names = ["entropy", "perplexity", "perplexity_large", "surprisal"]
    first, second = (sorted(map(tuple, detectors.score_units(texts, detectors.default_catalog().select(names), c).collect())) for c in (context, again))
    for a, b in zip(first, second, strict=True):
        assert a == pytest.approx(b)
    with pytest.raises(DetectorError):
        contexts.load(spark, str(tmp_path / "nothing"))


def test_command_line_scores_against_a_reference(spark, tmp_path):
    corpus, text = tmp_path / "corpus.jsonl", tmp_path / "text.txt"
    corpus.write_text(json.dumps({"text": LONG, "label": 0}))
    text.write_text(DULL)
    cli.main(["reference", "--dataset", str(corpus), "--out", str(tmp_path / "known")], spark)
    out = json.loads(cli.main(["detect", "--file", str(text), "--detector", "entropy", "--reference", str(tmp_path / "known")], spark))
    assert out["detectors"]["entropy"]["score"] == pytest.approx(0.8) and "error" not in out["detectors"]["entropy"]  # foreign to the reference
    text.write_text(LONG)
    own = json.loads(cli.main(["detect", "--file", str(text), "--detector", "entropy", "--reference", str(tmp_path / "known")], spark))
    assert own["detectors"]["entropy"]["score"] < 0.7 and len(own["sentences"]) == 40
    none = json.loads(cli.main(["detect", "--file", str(text), "--detector", "entropy"], spark))
    assert none["score"] == pytest.approx(0.5) and "no reference" in none["detectors"]["entropy"]["error"]
