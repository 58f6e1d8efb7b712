"""The trigram model against a literal recursion over lists."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from penmark.operators import kneser_ney
from penmark.operators.kneser_ney import KneserNey

TEXTS = [
    "the cat sat on the mat and the cat ran", "the dog sat on the cat", "a cat and a dog ran on the mat", "the the the the cat", "dog", "",
    "on the mat the dog sat and on the mat the cat sat", "a b a b a c a b a d a b", None, "the cat sat on the mat and the cat ran",
]


class Literal:
    def __init__(self, texts):
        words = [re.findall("[a-z]+", t or "") for t in texts]
        grams = [Counter(tuple((["", ""] + w)[i : i + 3]) for w in words for i in range(len(w)))]
        for _ in range(2):
            grams.append(Counter(g[1:] for g in grams[-1]))
        self.grams, self.vocabulary = grams, len(grams[2]) + 1

    def discount(self, k, n):
        sizes = Counter(self.grams[k].values())
        if not sizes[1] or not sizes[2]:
            return 0.5
        y, m = sizes[1] / (sizes[1] + 2 * sizes[2]), min(n, 3)
        return min(max(m - (m + 1) * y * sizes[m + 1] / sizes[m], 0), m) if sizes[m] else 0.5

    def probability(self, gram, k=0):
        if k == 3:
            return 1 / self.vocabulary
        lower = self.probability(gram[1:], k + 1)
        same = {g: n for g, n in self.grams[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return lower
        n, total = self.grams[k].get(gram, 0), sum(same.values())
        rest = sum(self.discount(k, m) for m in same.values()) / total
        return (n - self.discount(k, n) if n else 0) / total + rest * lower


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("gram", F.lit("clash")).repartition(3)


@pytest.mark.parametrize("broadcast_rows", [300_000, 0])
def test_surprisals_equal_the_recursion(spark, corpus, monkeypatch, broadcast_rows):
    monkeypatch.setattr(kneser_ney, "BROADCAST_ROWS", broadcast_rows)
    model, literal = KneserNey.count(corpus), Literal(TEXTS)
    assert model.vocabulary == literal.vocabulary
    unseen = [(100, "the zebra sat on a mat"), (100, "the zebra sat on a mat"), (None, "cat dog cat"), (101, None), (102, "zebra zebra zebra")]
    units = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(unseen, "doc_id long, text string"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["pos"], round(r["surprisal"], 9)) for r in kneser_ney.token_surprisals(units, model).collect())
    wanted = []
    for i, text in [*enumerate(TEXTS), *unseen]:
        words = ["", "", *re.findall("[a-z]+", text or "")]
        wanted += [(i is None, i or 0, k - 2, round(-math.log(literal.probability(tuple(words[k - 2 : k + 1]))), 9)) for k in range(2, len(words))]
    assert got == sorted(wanted)
    model.release()


def test_probabilities_of_a_context_sum_to_one(spark, corpus):
    model = KneserNey.count(corpus)
    words = sorted({w for t in TEXTS for w in re.findall("[a-z]+", t or "")}) + ["zebra"]
    assert len(words) == model.vocabulary
    contexts = ["the cat", " the", " ", "zebra the", "zebra zebra", "mat the"]
    grams = spark.createDataFrame([(f"{c} {w}",) for c in contexts for w in words], "gram string")
    found = model.probabilities(grams).groupBy(F.regexp_replace("gram", " [^ ]*$", "").alias("context")).agg(F.sum("p").alias("p")).collect()
    assert {r["context"]: pytest.approx(r["p"], abs=1e-12) for r in found} == dict.fromkeys(contexts, 1.0)


def test_empty_corpus(spark, corpus):
    model = KneserNey.count(corpus.limit(0))
    assert model.vocabulary == 1
    rows = kneser_ney.text_surprisals(corpus.where("doc_id = 1"), model).collect()
    assert [(r["n"], r["mean_surprisal"], r["perplexity"]) for r in rows] == [(6, 0.0, 1.0)]
    assert kneser_ney.text_surprisals(corpus.limit(0), model).count() == 0


def test_counted_trigrams_need_no_back_off_chain(spark, corpus, monkeypatch):
    literal = Literal(TEXTS)
    for limit in (300_000, 0):
        monkeypatch.setattr(kneser_ney, "BROADCAST_ROWS", limit)
        model = KneserNey.count(corpus)
        counted = kneser_ney.token_surprisals(corpus, model, counted=True)
        got = {(r["doc_id"], r["pos"]): r["surprisal"] for r in counted.collect()}
        wanted = {}
        for i, text in enumerate(TEXTS):
            words = ["", "", *re.findall("[a-z]+", text or "")]
            wanted |= {(i, k - 2): -math.log(literal.probability(tuple(words[k - 2 : k + 1]))) for k in range(2, len(words))}
        assert got == pytest.approx(wanted, abs=1e-12)
        model.release()
    # Shuffled are the trigrams by middle word, words, texts and trigrams by trigram, and nothing for each order.
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 4 and "w1" in plan
