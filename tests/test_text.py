import math
import statistics

import pytest
from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.functions import text as T


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "text string").select(expression.alias("x")).first()["x"]


def reference_chunks(text, size=512, overlap=128, least=50):
    if len(text) <= least:
        return [(text, 0, len(text), 0)]
    out, start, i = [], 0, 0
    while True:
        end = min(start + size, len(text))
        if end - start < size and len(text) > size:
            start, end = len(text) - size, len(text)
        out.append((text[start:end], start, end, i))
        i += 1
        if end == len(text):
            return out
        start += size - overlap


@pytest.mark.parametrize("n", [0, 1, 50, 51, 511, 512, 513, 896, 897, 2000])
def test_chunks(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = [(c["text"], c["start_char"], c["end_char"], c["chunk_index"]) for c in one(spark, text, T.chunks(F.col("text")))]
    assert got == reference_chunks(text)


def test_chunk_overlap_must_be_smaller():
    with pytest.raises(ValueError, match="overlap"):
        T.chunks(F.col("text"), size=10, overlap=10)


def test_normalized(spark):
    assert one(spark, "  Cafe\u0301\u00a0\n\n au\u2028lait ", T.normalized(F.col("text"))) == "Caf\u00e9 au lait"


def test_words_drop_tokens_with_digits_and_accents(spark):
    assert one(spark, "The cat's caf\u00e9 is b2b, snake_case OK", T.words(F.col("text"))) == ["the", "cat", "s", "is", "ok"]


def test_sentences(spark):
    text = "One here. Two there!  Three?"
    assert one(spark, text, T.sentences(F.col("text"))) == ["One here", "Two there", "Three"]
    assert one(spark, text, T.terminated_sentences(F.col("text"))) == ["One here.", "Two there!", "Three?"]
    assert one(spark, "", T.terminated_sentences(F.col("text"))) == []


def test_ngrams_and_run_lengths(spark):
    words = T.words(F.col("text"))
    assert one(spark, "a b c d", T.ngrams(words, 3)) == ["a b c", "b c d"]
    assert one(spark, "a b", T.ngrams(words, 3)) == []
    assert sorted(one(spark, "b a b c b a", T.run_lengths(words))) == [1, 2, 3]
    assert one(spark, "", T.run_lengths(words)) == []


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0, 4.0], [2.0, 2.0]])
def test_moments(spark, values):
    row = spark.createDataFrame([(values,)], "v array<double>").select(
        T.mean(F.col("v")).alias("m"), T.variance(F.col("v")).alias("p"), T.variance(F.col("v"), sample=True).alias("s")
    ).first()
    assert row["m"] == (statistics.mean(values) if values else 0)
    assert math.isclose(row["p"], statistics.pvariance(values) if values else 0, abs_tol=1e-12)
    assert math.isclose(row["s"], statistics.variance(values) if len(values) > 1 else 0, abs_tol=1e-12)


def test_citations(spark):
    f = X.citations(F.col("text"))
    row = spark.createDataFrame([("As (Smith, 2020) and [Jones, 2019] say; see 4 (2018).",)], "text string").select(*[c.alias(n) for n, c in f.items()]).first()
    assert row["citations_found"] == 3
    assert math.isclose(row["potential_hallucinations"], 2 / 3)


def test_unknown_language_family_has_the_default_threshold(spark):
    family, threshold = X.family_threshold(F.lit("xx"))
    row = spark.range(1).select(family.alias("f"), threshold.alias("t")).first()
    assert (row["f"], row["t"]) == ("other", 0.35)


def test_only_texts_that_may_change_are_composed_in_python(spark):
    """What Python gets of a batch does not grow with texts of characters that are composed as they are."""
    texts = ["plain", "Größe déjà", "é x", "", None, "한", "“q”   z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r["id"]: r["t"] for r in rows.select("id", T.normalized(F.col("text")).alias("t")).collect()}
    assert found == {0: "plain", 1: "Größe déjà", 2: "é x", 3: "", 4: None, 5: "한", 6: "“q” z"}
    plan = rows.select(T.normalized(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("_composed(") :].split("\n")[0]
    assert "CASE WHEN" in sent or "_composed(text" not in plan
