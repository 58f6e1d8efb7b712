"""Integrated gradients: completeness, numeric gradients on the path, odd texts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.operators import attribution, detectors
from penmark.operators.attribution import NgramScorer

LABELLED = [
    (1, "rain fell on old roofs", 0), (2, "the model is good and good", 1), (3, "the old clerk wrote home", 0), (4, "the model is the model", 1),
    (5, "the rain is good", 1), (6, None, 0), (7, "left out", None), (8, "", 1),
]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(LABELLED, "doc_id long, text string, label int").withColumn("token", F.lit("clash")).withColumn("pos", F.lit("clash"))


def literal_weights():
    counts = {}
    for _, text, label in LABELLED:
        if label is not None:
            t = (text or "").split()
            for g in [*t, *zip(t, t[1:], strict=False)]:
                counts.setdefault(g, [0, 0])[label] += 1
    out = {}
    for kind in (str, tuple):
        own = {g: n for g, n in counts.items() if isinstance(g, kind)}
        total = [sum(n[k] for n in own.values()) + len(own) for k in (0, 1)]
        out |= {g: math.log((n[1] + 1) / total[1]) - math.log((n[0] + 1) / total[0]) for g, n in own.items()}
    return out, math.log(4 / 3)


def literal(tokens, scale):
    """Score, and each token's attribution by numeric differences along the path."""
    weights, bias = literal_weights()

    def score(a):
        z = sum(x * weights.get(t, 0) for x, t in zip(a, tokens, strict=True))
        z += sum(x * y * weights.get(p, 0) for x, y, p in zip(a, a[1:], zip(tokens, tokens[1:], strict=False), strict=False))
        return 1 / (1 + math.exp(-bias - scale * z / len(tokens)))

    n, steps, h = len(tokens), 400, 1e-5
    out = np.zeros(n)
    for k in range(steps):
        at = np.full(n, (k + 0.5) / steps)
        for i in range(n):
            up, down = at.copy(), at.copy()
            up[i] += h
            down[i] -= h
            out[i] += (score(up) - score(down)) / (2 * h) / steps
    return score(np.ones(n)), out


@pytest.mark.parametrize("scale", [20.0, 300.0])
def test_attributions_are_the_path_integral(spark, labelled, scale):
    scorer = NgramScorer.fit(labelled, scale=scale)
    texts = [(1, "the model is good and new"), (2, "rain"), (3, ""), (4, None), (5, "old old old roofs roofs roofs fell on"), (6, "unheard of things"), (7, "the " * 3000 + "rain")]
    units = spark.createDataFrame(texts, "doc_id long, text string").withColumn("pair", F.lit("clash"))
    rows = scorer.attributions(units).orderBy("doc_id", "pos").collect()
    scores = {r["doc_id"]: r["score"] for r in scorer.score(units).collect()}
    assert len(scores) == len(texts) and scores[3] == scores[4] == pytest.approx(4 / 7)
    for i, text in texts:
        own, tokens = [r for r in rows if r["doc_id"] == i], (text or "").split()
        assert [r["token"] for r in own] == tokens
        if own:
            assert sum(r["attribution"] for r in own) == pytest.approx(own[0]["score"] - own[0]["baseline"], abs=1e-9)
            assert own[0]["score"] == pytest.approx(scores[i]) and own[0]["baseline"] == pytest.approx(4 / 7)
        if own and len(tokens) < 100:
            score, values = literal(tokens, scale)
            assert own[0]["score"] == pytest.approx(score)
            assert [r["attribution"] for r in own] == pytest.approx(list(values), abs=2e-4 if scale > 100 else 1e-5)
    maps = {r["doc_id"]: r["heatmap"] for r in attribution.heatmap(scorer.attributions(units)).collect()}
    assert sum(t["score"] for t in maps[1]) == pytest.approx(1) and [t["score"] for t in maps[6]] == [0.5] * 3
    assert attribution.heatmap(scorer.attributions(units.limit(0))).count() == 0


def test_one_label_and_detector(spark, labelled):
    flat = NgramScorer.fit(labelled.where("label = 1"))
    assert flat.bias == 0 and flat.weights.where("weight <> 0").count() == 0
    found = detectors.score_units(labelled.select("doc_id", "text"), [attribution.detector(NgramScorer.fit(labelled))], detectors.Context()).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["score"] > 0.9 > 0.1 > by_id[1]["score"] and by_id[8]["error"] and by_id[6]["score"] == 0.5
