"""Abbreviations, guarded sentences and trigram profiles against literal readings and fixtures."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from penmark.operators import language_profiles, sentences
from penmark.operators.language_profiles import Profiles

CORPUS = [
    "We met Dr. Smith and Dr. Jones in the park. The park was green, e.g. near the pond. It cost 3.14 euros.",
    "They asked Dr. Miller. He said that the park, e.g. the pond, was old. We went home.",
    "The bill of Mr. Green was long. He paid it. The doctor met Mr. Brown, e.g. at home.",
    "Dr. No came. The house was old! Was it? \"It was.\" They left (at last). the end",
    "On the 3. of May we saw Dr. Green. The dog ran. A dog ran off... The cat sat.",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t) for i, t in enumerate(CORPUS)] + [(90, None), (91, ""), (92, " \n "), (93, "." * 3), (94, "one long text without an end " * 2000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("type", F.lit("clash")).withColumn("pos", F.lit("clash")).repartition(3)


def literal_scores(texts):
    with_, without = Counter(), Counter()
    for text in texts:
        for token in (text or "").split():
            core = re.sub(r"""[)"'\],;:]+$""", "", re.sub(r"""^[("'\[]+""", "", token))
            if re.match(r"^[^\W\d_][^\W\d_.'-]*[^\W\d_.'-]*", core) and re.fullmatch(r"[a-zA-Z][a-zA-Z.'-]*", core) and not core.endswith(".."):
                (with_ if core.endswith(".") else without)[core.removesuffix(".").lower()] += 1
    p = sum(with_.values()) / (sum(with_.values()) + sum(without.values()))
    out = {}
    for w, k in with_.items():
        m, letters, inner = without[w], len(w.replace(".", "")), w.count(".")
        likely = lambda q, k=k, m=m: k * math.log(q) + (m * math.log(1 - q) if m else 0)
        out[w] = 2 * (likely(0.99) - likely(p)) * math.exp(-letters) * (inner + 1) * letters ** -float(m)
    return out


def test_scores_of_types(spark, corpus):
    counts = sentences.type_counts(corpus)
    got = {r["type"]: r["score"] for r in sentences.scored_types(counts).collect()}
    texts = [r["text"] for r in corpus.collect()]
    assert got == pytest.approx(literal_scores(texts))
    assert {r["type"] for r in sentences.abbreviations(counts).collect()} == {w for w, s in literal_scores(texts).items() if s >= 0.3}


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_abbreviations_and_decimals_do_not_end_sentences(spark, corpus, monkeypatch, broadcast_rows):
    monkeypatch.setattr(sentences, "BROADCAST_ROWS", broadcast_rows)
    found = {r["doc_id"]: r["sentences"] for r in sentences.guarded_sentences(corpus, sentences.type_counts(corpus)).collect()}
    assert found[0] == ["We met Dr. Smith and Dr. Jones in the park.", "The park was green, e.g. near the pond.", "It cost 3.14 euros."]
    assert found[2] == ["The bill of Mr. Green was long.", "He paid it.", "The doctor met Mr. Brown, e.g. at home."]
    assert found[3] == ["Dr. No came.", "The house was old!", "Was it?", '"It was."', "They left (at last).", "the end"]
    assert found[4] == ["On the 3. of May we saw Dr. Green.", "The dog ran.", "A dog ran off...", "The cat sat."]
    assert found[90] == found[91] == found[92] == [] and found[93] == ["..."] and len(found[94]) == 1 and len(found) == corpus.count()
    assert sentences.guarded_sentences(corpus.limit(0), sentences.type_counts(corpus.limit(0))).count() == 0


def test_profiles_against_counting(spark):
    labelled = [("the house on the hill", "en"), ("das haus auf dem berg", "de"), ("die katze im haus", "de"), ("a cat", "en"), (None, "en"), ("nichts", None), ("la maison", "fr")]
    df = spark.createDataFrame(labelled, "text string, lang string").withColumn("gram", F.lit("clash"))
    texts = [(1, "the cat"), (2, "Das Haus"), (3, "xyzzy"), (4, None), (5, "12 34"), (6, "MAISON"), (7, "é"), (8, "the house " * 5000)]
    units = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit("clash"))
    grams = lambda text: [f" {w} "[i : i + 3] for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for i in range(len(w))]
    counts = {lang: Counter(g for t, own in labelled if own == lang for g in grams(t)) for lang in ("de", "en", "fr")}
    distinct = len(set().union(*counts.values()))
    got = {r["doc_id"]: r for r in Profiles.learn(df).identify(units).collect()}
    for i, text in texts:
        own = grams(text)
        scores = sorted(((-sum(math.log((c[g] + 1) / (sum(c.values()) + distinct)) for g in own), lang) for lang, c in counts.items())) if own else []
        assert got[i]["n_trigrams"] == len(own)
        assert got[i]["language"] == (scores[0][1] if own else "unknown")
        assert got[i]["margin"] == (pytest.approx((scores[1][0] - scores[0][0]) / len(own)) if own else None)
    assert Profiles.learn(df.limit(0)).identify(units).where("language <> 'unknown'").count() == 0
    monoglot = Profiles.learn(df.where("lang = 'fr'")).identify(units.where("doc_id = 1")).first()
    assert (monoglot["language"], monoglot["margin"]) == ("fr", 0.0)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    found = Profiles.learn(documents.where(~held)).identify(documents.where(held)).join(documents, "doc_id").where("language <> 'unknown'")
    right, all_ = found.agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert all_ > 100 and right / all_ > 0.97, (right, all_)


def test_profile_as_arrays_equals_the_joined_one(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "the cat, a Öl x", "en"), (2, "der Hund und a x1y", "de"), (3, None, "en"), (4, "12 !", "de"), (5, "𝒜b c", None), (6, "und the", None), (7, "zzz", None)], "doc_id long, text string, lang string")
    own = Profiles.learn(rows)
    grams = rows.where("lang = 'en'").selectExpr("text").select(language_profiles.trigrams(F.col("text")).alias("g"))
    assert {r["gram"] for r in own.gains.where("g1 > 0").collect()} == {g for r in grams.collect() for g in r["g"] or []}
    read = lambda: {r["doc_id"]: (r["language"], r["n_trigrams"], r["margin"] and round(r["margin"], 9)) for r in own.identify(rows).collect()}
    arrays = read()
    monkeypatch.setattr(language_profiles, "FEW_LANGUAGES", 0)
    assert arrays == read()
    assert arrays[3] == ("unknown", 0, None) and arrays[5][1] == 3


def test_types_are_counted_in_their_task(spark, monkeypatch):
    """Equal tokens are one row of the shuffle, however often they occur; the counts are those of every token by itself."""
    text = "The end. the end (at last!) The\x1cend \u2003 The Ünd. und? Und \"ok?\" Ok etc. Etc.) x.. Öl"
    rows = spark.createDataFrame([(i, text) for i in range(200)] + [(900, None), (901, " "), (902, "One")], "doc_id long, text string").coalesce(1)
    got = {r["type"]: tuple(r)[1:] for r in sentences.type_counts(rows).collect()}
    assert got["the"] == (0, 600, 200, 200, 200) and got["end"] == (200, 200, 400, 0, 0)
    assert got["und"] == (0, 200, 0, 0, 200) and got["ünd"] == (200, 0, 0, 200, 0) and got["ok"] == (0, 200, 0, 0, 200) and got["one"] == (0, 1, 0, 0, 1)
    assert got["etc"] == (400, 0, 200, 0, 0) and "x." not in got and got["öl"] == (0, 200, 0, 0, 0)
    assert "MapInArrow" in sentences.type_counts(rows)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(sentences, "DISTINCT_TOKENS", 3)
    assert {r["type"]: tuple(r)[1:] for r in sentences.type_counts(rows).collect()} == got
