"""Token counts of all prefixes against the tokenizers library, which encodes each prefix anew."""

import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from penmark.llm import session, token_counts

FOLDER = "/root/testdata/sf0.001"
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'re", "'ve", "'ll", "'s", "'", "the", "ing", "1", "23", "!", "\xe9", "\xdf", "中文", "\U0001f600", "<|endoftext|>", "<|", "<", "　", "\xa0", "Ω", "x" * 9, "  \n x", "--", "\x1c"]


@cache
def counter():
    with open(token_counts.default_tokenizer(), encoding="utf-8") as file:
        return token_counts.PrefixCounter(file.read())


def literal(text):
    return [len(counter().library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def longest(counts, budget):
    return max(i for i, n in enumerate(counts) if n <= budget)


@pytest.mark.parametrize("slice_chars", [500_000, 3, 1])
def test_every_prefix_equals_the_library(monkeypatch, slice_chars):
    monkeypatch.setattr(token_counts, "SLICE", slice_chars)
    rng = random.Random(slice_chars)
    for _ in range(700):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        wanted, budget = literal(text), rng.randint(0, 12)
        assert [0, *(int(n) for part in counter().counts(text) for n in part)] == wanted
        assert counter().total(text, budget) == (wanted[-1], longest(wanted, budget))


def test_every_token_is_reached():
    library = counter().library
    assert all([t.id for t in library.model.tokenize(piece)] == [i] for i, piece in counter().pieces.items())


def test_forgetful_worker_counts_alike(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_CHARACTERS", 20)
    monkeypatch.setattr(token_counts, "KEPT_PAIRS", 5)
    text = "Anhation to thlyth esherehati esndly sttiing the. " * 3
    with open(token_counts.default_tokenizer(), encoding="utf-8") as file:
        small = token_counts.PrefixCounter(file.read())
    assert small.total(text, 10) == (literal(text)[-1], longest(literal(text), 10))


def test_query_equals_the_library(spark):
    documents = session.table(spark, FOLDER, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    got = token_counts.op13_token_counts(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        text = texts[r["doc_id"]]
        n = len(counter().library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
        assert len(counter().library.encode(text[: r["fit_chars"]], add_special_tokens=False).ids) <= 512
        assert (r["fit_chars"] == len(text)) == (n <= 512)


def test_odd_rows_and_prefix_questions(spark):
    rows = [(1, "don't stop   now"), (1, "don't stop   now"), (2, None), (None, "x"), (3, ""), (4, " \n "), (5, "ab " * 40_000), (6, "we're <|endoftext|> ok")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("id", "counts", "n_tokens", "budget"):
        df = df.withColumn(c, F.lit("clash"))
    found = token_counts.token_counts(df, budget=4, with_counts=True)
    got = found.select("*", token_counts.tokens_of_prefix(F.col("counts"), 5).alias("five"), token_counts.fitting_prefix(F.col("counts"), 4).alias("fit")).collect()
    assert len(got) == len(rows) and got.count(got[0]) == 2
    for r, (_, text) in zip(got, rows, strict=True):
        text = text or ""
        if len(text) < 100:
            assert list(r["counts"]) == literal(text)
            assert r["five"] == literal(text)[min(5, len(text))]
        assert r["n_tokens"] == r["counts"][-1] and r["fit_chars"] == r["fit"] == longest(r["counts"], 4)
    assert token_counts.token_counts(df.limit(0)).count() == 0
    assert all(r["over_limit"] == (r["n_tokens"] > 4) for r in got)
