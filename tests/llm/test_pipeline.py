"""Each stage of the pipeline on its own input, against what it must keep and cut."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from penmark.llm import session

FOLDER = "/root/testdata/sf0.001"
BEFORE = ("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def stages(spark):
    docs = session.table(spark, FOLDER, "documents")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src0", 0), (-3, "12 !?", None, None, 5)], docs.schema)
    out = [docs.select(*BEFORE).unionByName(odd)]
    for _, stage in P.STAGES:
        out.append(session.checkpointed(stage(spark, out[-1], FOLDER)))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_return_documents(stages):
    for df in stages[1:-1]:
        assert tuple(df.columns) == BEFORE
        assert df.where("n_chars <> length(text)").count() == 0


def test_language_stage_rejects_texts_without_letters_only(stages):
    assert set(rows(stages[0])) - set(rows(stages[1])) == {-1, -2, -3}


def test_line_stage_against_brute_force(stages):
    before, after = rows(stages[1]), rows(stages[2])
    sites, first = {}, {}
    for i in sorted(before):
        for pos, line in enumerate(before[i]["text"].split("\n")):
            if line.strip():
                sites.setdefault(line, set()).add(before[i]["source"])
                first.setdefault(line, (i, pos))
    for i, r in before.items():
        lines = r["text"].split("\n")
        kept = "\n".join(x for pos, x in enumerate(lines) if not (x.strip() and len(sites[x]) >= 10) or first[x] == (i, pos))
        if kept.strip() or kept == r["text"]:
            assert after[i]["text"] == kept
        else:
            assert i not in after


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_join_stage_keeps_the_first_of_each_group(stages):
    before, after = rows(stages[2]), rows(stages[3])
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    assert set(after) == {i for i in ids if root(i) == i}
    assert all(after[i]["text"] == before[i]["text"] for i in after)


def test_decontamination_stage_leaves_no_window_and_clean_documents_alone(spark, stages):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in session.table(spark, FOLDER, "benchmark").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    before, after = rows(stages[3]), rows(stages[4])
    changed = 0
    for i, r in before.items():
        w = words(r["text"])
        dirty = any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
        changed += dirty
        if not dirty:
            assert after[i]["text"] == r["text"]
        elif i in after:
            assert len(after[i]["text"]) < len(r["text"])
    assert changed


def test_last_stage_has_the_tokens_of_all_that_is_left(stages):
    assert set(rows(stages[5])) == set(rows(stages[4]))
    assert stages[5].where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_run_equals_the_stages(spark, stages):
    got = rows(P.run(spark, FOLDER).select("doc_id", "ids_sha256"))
    assert {i: r["ids_sha256"] for i, r in got.items()} == {i: r["ids_sha256"] for i, r in rows(stages[5]).items()}
