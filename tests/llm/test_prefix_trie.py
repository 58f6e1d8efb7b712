"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from penmark.llm import prefix_trie, session

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def literal(paths):
    """All nodes of {conversation: turns}, each turn (role, text)."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), set()).add(c)
    children = {u: [v for v in members if len(v) == len(u) + 1 and v[:-1] == u] for u in members}

    def subtree(u):
        yield u
        for v in children[u]:
            yield from subtree(v)

    saved = {u: (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", u[-1][1])) if u else 0 for u, own in members.items()}
    for u, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(u))
        nodes = list(subtree(u))
        yield (
            min(own), len(u), min(members[u[:-1]]) if u else None, len(own), len(children[u]), sum(not children[v] for v in nodes),
            sum(saved[v] for v in nodes), hashlib.sha256(ends.encode()).hexdigest(),
        )


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def some_conversations(rng, n, kinds, longest):
    out = {}
    for c in rng.sample(range(-50, 400), n):
        out[c] = [("u", " ".join("w" * rng.randint(0, 2) for _ in range(2)) + rng.choice("abc"[:kinds])) for _ in range(rng.randint(1, longest))]
        if out and rng.random() < 0.3:
            out[c] = list(rng.choice(list(out.values())))
    return out


def table_of(spark, conversations):
    rows = [(c, i, role, text) for c, path in conversations.items() for i, (role, text) in enumerate(path)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize(("seed", "n", "kinds", "longest", "parts"), [(0, 30, 1, 4, 1), (1, 60, 2, 6, 5), (2, 80, 1, 9, 9), (3, 40, 3, 3, 30), (4, 3, 1, 40, 2)])
def test_nodes_against_all_prefixes(spark, monkeypatch, seed, n, kinds, longest, parts):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 3)
    conversations = some_conversations(random.Random(seed), n, kinds, longest)
    paths = prefix_trie.conversation_paths(table_of(spark, conversations))
    assert rows_of(prefix_trie.prefix_trie(paths, parts=parts)) == sorted(literal(conversations), key=repr)


def test_long_chains_over_many_parts(spark):
    """Every prefix of one long conversation is a conversation, so every part holds points of all the others' paths."""
    conversations = {c: [("u", f"t {i}") for i in range(c)] for c in range(1, 60)} | {99: [("u", "t 0"), ("u", "x")]}
    paths = prefix_trie.conversation_paths(table_of(spark, conversations))
    assert rows_of(prefix_trie.prefix_trie(paths, parts=7)) == sorted(literal(conversations), key=repr)


def test_odd_rows(spark):
    rows = [
        (1, 0, "u", "a b"), (1, 0, "u", "a b"), (1, None, None, None), (2, None, "", ""), (2, 0, "u", "a b"), (2, 5, "u", "a b"),
        (3, 1, "u", "x" * 50_000), (None, 0, "u", "a b"), (4, 1, "ua", " b"), (5, 1, "u", "a b"), (6, 2, "u", "a b"), (6, 2, "v", "c"), (7, 2, "v", "c"), (7, 2, "u", "a b"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for c in ("key", "path", "n", "part", "depth"):
        df = df.withColumn(c, F.lit("clash"))
    key = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    paths = {}
    for c, turn, role, text in rows:
        if c is not None:
            paths.setdefault(c, []).append((turn is not None, turn or 0, key(role or "", text or ""), (role or "", text or "")))
    paths = {c: [x[-1] for x in sorted(own)] for c, own in paths.items()}
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.conversation_paths(df), parts=2)) == sorted(literal(paths), key=repr)
    assert prefix_trie.prefix_trie(prefix_trie.conversation_paths(df.limit(0))).count() == 0


def shared_starts(given):
    out = {}
    for c, own in given.items():
        of, h = c - c % 20, zlib.crc32(str(c).encode()) % 4
        out[c] = given.get(of, [])[:h] + own[h:]
    return out


def test_conversations_without_turns_end_at_the_root(spark):
    given = {c: [("u", f"{c}")] for c in range(21, 29)}
    paths = shared_starts(given)
    assert sum(not p for p in paths.values()) > 1
    found = prefix_trie.prefix_trie(prefix_trie.with_shared_starts(prefix_trie.conversation_paths(table_of(spark, given))), parts=2)
    assert rows_of(found) == sorted(literal(paths), key=repr)


def test_query_against_dictionary_and_sql(spark):
    given = {}
    for r in sorted(session.table(spark, FOLDER, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        given.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = rows_of(prefix_trie.op12_conversation_prefix_trie(spark, FOLDER))
    assert got == sorted(literal(shared_starts(given)), key=repr)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    assert got == sorted(duck.sql(prefix_trie.OP12_SQL).project(", ".join(COLUMNS)).fetchall(), key=repr)
