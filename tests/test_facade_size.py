"""Whole documents: words looked up by blocks, chunks cut once, features of the chunks that are asked for."""

import pytest
from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.functions import text as T
from penmark.operators import detectors, facade, grains, looked_up

SENTENCE = "The small cat sat on the old mat and saw a big dog run to the far end of town. "


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame([("the", 0.5), ("cat", 0.25), ("dog", 0.125), ("unseen", 0.125)], "word string, q double")


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(1, SENTENCE * 30), (2, "a few words"), (3, None), (4, SENTENCE * 12 + "Moreover it rained. " * 20), (None, SENTENCE * 15)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_divergence_by_blocks_equals_that_by_a_join(spark, reference, monkeypatch):
    rows = [(1, "the cat"), (1, "cat dog zebra"), (2, "the the the dog"), (3, None), (4, ""), (None, "the zebra"), (5, "zebra")]
    units = spark.createDataFrame(rows, "k long, text string").select(F.struct("k", F.lit(0).alias("i")).alias("unit"), "k", "text")
    for key in ("unit", "k"):
        joined = grains.kl_divergence(units, reference, key)
        with monkeypatch.context() as patched:
            patched.setattr(grains, "BROADCAST_ROWS", 2)
            found = grains.kl_divergence(units, reference, key)
            assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString() and "Generate" not in found._jdf.queryExecution().executedPlan().toString()
            ordered = lambda frame: sorted((str(r[0]), round(r[1], 12)) for r in frame.collect())
            assert ordered(found) == ordered(joined)


def test_looked_up_values_are_the_same_in_many_blocks(spark, reference):
    units = spark.createDataFrame([(i, f"the cat w{i}x and dog {'unseen ' * i}") for i in range(40)], "k long, text string")
    total = lambda text, word, q, n: __import__("numpy").bincount(text, weights=__import__("numpy").nan_to_num(q)[word], minlength=n)
    found = looked_up.looked_up(units, T.words, reference, "q", total, id_col="k", block_bytes=100)
    assert {r["k"]: r["q"] for r in found.collect()} == {i: pytest.approx(0.875 + 0.125 * i) for i in range(40)}


def test_chunks_are_cut_once_for_all_detectors(spark, documents, reference, monkeypatch):
    monkeypatch.setattr(grains, "BROADCAST_ROWS", 2)
    chosen = detectors.default_catalog().select(("entropy", "repetition", "stylometric", "cognitive"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = facade.detect(documents, chosen, detectors.Context(reference), strategy="mean")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("ArrowEvalPython [_composed") == 1 and "ReusedExchange" in plan


def test_features_are_those_of_the_first_chunks_and_the_last(spark, documents, reference):
    chosen = detectors.default_catalog().select(("stylometric",))
    for top, most in ((10, 20), (3, 7), (2, 40)):
        found = {r["doc_id"]: r for r in facade.results(documents, chosen, detectors.Context(reference), top=top, most_features=most).where("doc_id is not null").collect()}
        assert found[2]["features"] is None and found[3]["top_features"] is None
        chunks = grains.chunked(facade.prepared(documents).where("not short and doc_id is not null"), "doc_id")
        numbers = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), v.cast("double").alias("value")) for n, v in X.stylometry(F.col("text")).items()]))
        each = chunks.select("doc_id", "chunk_index", numbers.alias("f")).select("doc_id", "chunk_index", "f", facade.importance(F.col("f"), top).alias("first")).orderBy("doc_id", "chunk_index").collect()
        for doc in (1, 4):
            own = [r for r in each if r["doc_id"] == doc]
            assert found[doc]["n_chunks"] == len(own) and found[doc]["features"] == pytest.approx(own[-1]["f"])
            wanted = [tuple(x) for r in own for x in r["first"]][:most]
            assert [x["feature"] for x in found[doc]["top_features"]] == [w[0] for w in wanted]
            assert [x["importance"] for x in found[doc]["top_features"]] == pytest.approx([w[1] for w in wanted])


def test_normalized_texts_have_the_words_of_the_raw_ones(spark):
    rows = spark.createDataFrame([("a  b\tc d \n e ",), ("  　",), ("",), (None,), ("one",), ("é x́  y",)], "text string").select("text", F.lit(1).alias("doc_id"))
    found = facade.prepared(rows).select("raw", "text", "n_words", F.size(T.tokens(F.col("raw"))).alias("n")).collect()
    assert all(r["n_words"] == (None if r["raw"] is None else r["n"]) for r in found)
    assert {r["raw"]: r["text"] for r in found}["a  b\tc d \n e "] == "a b c d e"
