"""What plans must not hold: shuffles that grow faster than the texts, features computed more than once for a row."""

import pytest
from pyspark.sql import functions as F

from penmark.operators import detectors, facade, grains, lm
from penmark.plans import scoring


@pytest.fixture
def texts(spark):
    rows = [(1, "One two three four five.\n\nOne two three four six.\n\nshort one\n\nSeven of the five were one two."), (2, "No paragraphs here, but words."), (3, ""), (4, None)]
    return spark.createDataFrame(rows, "id long, text string")


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def _shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_self_bleu_shuffles_nothing(texts):
    found = grains.self_bleu(texts, "id")
    assert _shuffles(found) == 0
    values = {r["id"]: r["self_bleu"] for r in found.collect()}
    assert values[2] == values[3] == values[4] == 0 and 0 < values[1] < 1


def test_divergence_counts_words_in_one_shuffle(spark, texts):
    reference = spark.createDataFrame([("one", 0.5), ("two", 0.5)], "word string, q double")
    assert _shuffles(grains.kl_divergence(texts, reference, "id")) <= 2


@pytest.mark.parametrize(("name", "pattern", "most"), [("multilingual", "[\\p{L}\\p{N}_]+", 1), ("multilingual", "[\\p{L}]+", 1), ("cognitive", "\n\n", 1), ("stylometric", "[.!?]+", 1), ("academic", "\\(", 12)])
def test_features_are_computed_once_for_a_row(texts, name, pattern, most):
    plan = _plan(detectors.score_units(texts, [scoring.CATALOG.get(name)], detectors.Context(), "id"))
    assert plan.count(pattern) <= most


def test_repeated_ids_are_one_unit_of_the_divergence(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "a b b c")], "id long, text string")
    values = [r["kl_divergence"] for r in grains.kl_divergence(rows, grains.reference_frequencies(rows), "id").collect()]
    assert len(values) == 3 and max(values) - min(values) < 1e-12


def test_texts_are_prepared_once_below_a_filter(spark):
    frame = facade.prepared(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(1)).where(~F.col("short"))
    assert _plan(frame).count("(?U)\\s+") <= 2  # the normalised text and the number of its tokens


def test_row_wise_detectors_share_one_pass(texts):
    found = detectors.score_units(texts, scoring.CATALOG.select(["repetition", "stylometric", "cognitive"]), detectors.Context(), "id")
    assert _plan(found).count("\\b[a-zA-Z]+\\b") == 1 and "Union" not in _plan(found)
    got = {(r["id"], r["detector"]): (r["score"], r["confidence"]) for r in found.collect()}
    assert got[1, "repetition"] == (pytest.approx(2 / 17), 0.4) and got[3, "repetition"] == (0.5, 0.0)


def test_curvature_splits_and_scores_its_texts_once(spark):
    texts = spark.createDataFrame([(1, "a b c a b d a b c"), (2, "a zebra b a"), (3, "a b")], "doc_id long, text string")
    unigrams = spark.createDataFrame([("a", 5), ("b", 4), ("c", 2), ("d", 1)], "word string, uc long")
    bigrams = spark.createDataFrame([("a", "b", 4), ("b", "c", 2), ("b", "d", 1), ("c", "a", 1), ("d", "a", 1)], "before string, word string, bc long")
    model = lm.BigramModel(unigrams, bigrams, unigrams.agg(F.count("*").alias("v")))
    found = lm.curvature(texts, model)
    assert _plan(found).count("\\b[a-zA-Z]+\\b") == 1
    rows = {r["doc_id"]: r for r in found.collect()}
    assert set(rows) == {1, 2}  # a text of two words has no inner one
    own = {r["doc_id"]: r["p"] for r in lm.token_surprisals(texts, model).groupBy("doc_id").agg((-F.avg("surprisal")).alias("p")).collect()}
    assert {i: r["original_log_prob"] for i, r in rows.items()} == pytest.approx({i: own[i] for i in rows})


def test_repeated_ngrams_are_counted_in_their_row(spark, texts):
    found = grains.repeated_ngrams(texts, "id")
    assert _shuffles(found) == 1
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(1, 1, 4, "one two three four", 2), (1, 2, 3, "one two three", 2), (1, 3, 3, "two three four", 2)]
