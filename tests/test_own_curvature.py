"""Curvature of texts that are the whole corpus: by blocks it is that of the counted model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.operators import detectors, lm, own_curvature

ONCE = "the cat sat on the mat. The dog ran to the cat and the end of a day"
TEXTS = [("a", ONCE), ("b", None), ("c", ""), ("d", "one"), ("e", "two words"), ("f", "one two three"), ("g", "the cat ran to the dog and the mat sat on a cat " * 40), ("h", "12 34"), ("i", ONCE), ("j", "a b a c a d a b a e " * 30)]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(TEXTS, "name string, text string")


def _rows(frame):
    return {r[0]: tuple(r[1:]) for r in frame.collect()}


@pytest.mark.parametrize(("top", "share"), [(50, 0.15), (2, 0.5), (1, 1.0)])
def test_own_texts_equal_the_counted_model(units, top, share):
    got = lm.curvature(units, lm.OwnTexts(), "name", top=top, share=share)
    wanted = lm.curvature(units, lm.BigramModel.count(units, "name"), "name", top=top, share=share)
    assert got.columns == wanted.columns
    found, expected = _rows(got), _rows(wanted)
    assert set(found) == set(expected) == {"a", "f", "g", "i", "j"}
    assert all(found[i] == pytest.approx(expected[i], abs=1e-12) for i in expected)


def test_many_blocks_give_the_same(units):
    whole = _rows(lm.curvature(units, lm.OwnTexts(), "name"))
    drawn = own_curvature.own_draws(units, "name", "text", replicas=10, share=0.15, top=50, seed=42, added=lm.ADDED, block_bytes=100)
    assert {r["name"]: -r["mean"] for r in drawn.collect()} == pytest.approx({i: r[1] for i, r in whole.items()})
    assert {r["name"]: -r["change"] for r in drawn.collect()} == pytest.approx({i: r[0] for i, r in whole.items()}, abs=1e-12)


def test_no_word_or_draw_is_a_row(units):
    found = lm.curvature(units, lm.OwnTexts(), "name")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    scores = detectors.score_units(units, [detectors.default_catalog().get("curvature")], detectors.Context(model=lm.OwnTexts()), "name")
    assert "Generate explode(" not in scores._jdf.queryExecution().executedPlan().toString()
    by_name = {r["name"]: r["error"] for r in scores.collect()}
    assert set(by_name) == {t[0] for t in TEXTS} and by_name["a"] is None and by_name["e"] is not None


def test_steps_hold_whole_texts():
    sizes = np.array([own_curvature.STEP, 1, own_curvature.STEP * 3, 5, 6])
    assert list(own_curvature._steps(sizes)) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert list(own_curvature._steps(np.zeros(0, np.int64))) == []


def test_hashes_go_on_as_those_of_columns(spark):
    row = spark.range(1).select(F.xxhash64(F.lit(42), "id").alias("a"), F.xxhash64(F.lit(42), "id", F.lit(7)).alias("b"), F.xxhash64(F.lit(42), "id", F.lit(7), F.lit("draw")).alias("c")).first()
    b = own_curvature.chained(np.array([row["a"]]).view(np.uint64), np.array([7], np.uint64))
    assert b.view(np.int64)[0] == row["b"] and own_curvature.chained(b, own_curvature._DRAW).view(np.int64)[0] == row["c"]


@pytest.mark.parametrize("values", [[], [0], [1, 255, 256, 2**32 - 1], [5, 2**33]])
def test_packed_counts_are_read_again(values):
    assert own_curvature._counts(own_curvature._packed(np.array(values, np.int64))).tolist() == values
