"""Periodic runs against a search over all periods and places."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from penmark.llm import periodic_runs, session, suffix_tree
from penmark.llm.textbytes import string_buffer

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def literal(words, min_length=6, min_exponent=4):
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    runs = sorted((s, n, q) for (s, n), q in found.items())
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def some_text(rng):
    n, kinds = rng.choice([0, 1, 3, 8, 20, 60, 200]), rng.choice([1, 2, 3, 5, 50])
    words = [rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[:kinds]) * rng.choice([1, 1, 2]) for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return rng.choice(["", " ", "\n"]) + "".join(w + rng.choice([" ", "  ", "\n", "\t \x0b"]) for w in words)


def test_suffix_tree_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40):
        symbols = np.append(rng.integers(0, 3, n), 9)
        tree = suffix_tree.SuffixTree(symbols)
        suffixes = [list(symbols[i:]) for i in range(n + 1)]
        assert list(tree.order) == sorted(range(n + 1), key=lambda i: suffixes[i])
        nodes = {(d, tuple(sorted(tree.order[a:b]))) for d, a, b in zip(tree.depth, tree.low, tree.high, strict=True)}
        labels = {tuple(s[:d]) for s in suffixes for d in range(1, len(s))}
        starts = {u: [i for i, s in enumerate(suffixes) if tuple(s[: len(u)]) == u] for u in labels}
        branching = {(len(u), tuple(at)) for u, at in starts.items() if len({tuple(suffixes[i][len(u) : len(u) + 1]) for i in at}) > 1}
        assert nodes == branching
        for k in range(tree.depth.size):
            own = tree.child_node == k
            assert [tree.low[k], *tree.child_high[own]] == [*tree.child_low[own], tree.high[k]]


@pytest.mark.parametrize(("min_length", "min_exponent"), [(6, 4), (1, 2), (6, 3)])
def test_runs_and_collapsed_texts(min_length, min_exponent):
    rng = random.Random(min_exponent)
    for _ in range(150):
        texts = [some_text(rng) for _ in range(rng.choice([1, 3, 10]))]
        runs, collapsed = periodic_runs._runs_of_texts(*string_buffer(pa.array(texts)), min_length, min_exponent)
        for text, own, short in zip(texts, runs.to_pylist(), collapsed.to_pylist(), strict=True):
            assert ([(r["start"], r["length"], r["period"]) for r in own], short) == literal(words_of(text), min_length, min_exponent)


def test_long_runs_take_no_square_of_their_length():
    texts = ["a " * 200_000, "a b " * 50_000 + " ".join(map(str, range(50_000)))]
    runs, collapsed = periodic_runs._runs_of_texts(*string_buffer(pa.array(texts)), 6, 4)
    assert [[tuple(r.values()) for r in own] for own in runs.to_pylist()] == [[(0, 200_000, 1)], [(0, 100_000, 2)]]
    assert collapsed[0].as_py() == "a"


def test_odd_rows(spark):
    rows = [(1, "x y " * 5), (1, "x y " * 5), (2, None), (None, "z " * 7), (3, ""), (4, " \n\t "), (5, "w" * 70_000), (6, "é é é é é é é!")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("id", "runs", "collapsed_text", "start"):
        df = df.withColumn(c, F.lit("clash"))
    got = periodic_runs.periodic_runs(df).collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for r, (_, text) in zip(got, rows, strict=True):
        assert ([tuple(x) for x in r["runs"]], r["collapsed_text"]) == literal(words_of(text))
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_query_against_a_literal_reading(spark):
    texts = {r["doc_id"]: r["text"] for r in session.table(spark, FOLDER, "documents").collect()}
    got, planted = periodic_runs.op11_periodic_run_detection(spark, FOLDER).collect(), 0
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        words = words_of(texts[r["doc_id"]])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words, planted = [words[i if i < a else a + (i - a) % p] for i in range(n)], planted + 1
        runs, short = literal(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert (r["runs_sha256"], r["collapsed_sha256"]) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, short))
    assert planted > 5


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    wanted = duck.sql(periodic_runs.OP11_SQL)
    got = periodic_runs.op11_periodic_run_detection(spark, FOLDER).select(*wanted.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted.fetchall()))
