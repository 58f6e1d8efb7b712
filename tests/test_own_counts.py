"""Surprisals of texts that are the whole corpus: by blocks they are those of the counted model."""

import pytest

from penmark.operators import lm

TEXTS = [(1, "the cat sat on it. the cat ran to the end. A dog sat there now. the end of it"), (2, None), (3, ""), (4, "one"), (5, "the cat sat on the mat and the cat " * 90), (6, "12 34"), (7, "the cat sat on it. the cat ran to the end. A dog sat there now. the end of it")]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def _rounded(frame):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect())


@pytest.mark.parametrize("made", [
    lm.token_surprisals,
    lambda u, m: lm.surprisal_stats(lm.surprisals(u, m)),
    lambda u, m: lm.windowed_perplexity(lm.surprisals(u, m)),
    lambda u, m: lm.sentence_burstiness(u, m),
    lambda u, m: lm.stylometric_surprisals(u, lm.surprisals(u, m)),
])
def test_own_texts_equal_the_counted_model(units, made):
    model = lm.BigramModel.count(units)
    got, wanted = made(units, lm.OwnTexts()), made(units, model)
    assert got.columns == wanted.columns
    assert _rounded(got) == _rounded(wanted) != []


def test_words_are_not_shuffled_one_by_one(units):
    from pyspark.sql import functions as F

    plan = lm.surprisal_stats(lm.surprisals(units, lm.OwnTexts())).groupBy().agg(F.count("*"))._jdf.queryExecution().toString()
    assert "explode" not in plan.lower().replace("posexplode", "explode")


def test_own_scorer_equals_the_fitted_one(spark, units):
    from penmark.operators.attribution import NgramScorer, OwnNgramScorer

    labels = spark.createDataFrame([(1, 0), (5, 1), (4, 1), (4, 1), (7, None), (6, 2), (99, 0)], "doc_id long, label int")
    own, fitted = OwnNgramScorer(labels), NgramScorer.fit(units.join(labels, "doc_id"))
    for made in (lambda s: s.score(units), lambda s: s.attributions(units).select("doc_id", "pos", "token", "attribution", "score", "baseline")):
        assert _rounded(made(own)) == _rounded(made(fitted)) != []
    alone = labels.where("label = 1")
    assert _rounded(OwnNgramScorer(alone).score(units)) == _rounded(NgramScorer.fit(units.join(alone, "doc_id")).score(units))
