"""Ranking metrics against a literal walk down the scores, and strata by grouping sets against rows copied into strata."""

import random

import pytest
from pyspark.sql import functions as F

from penmark.operators import metrics

NAMES = ("auroc", "average_precision", "auprc", "fpr_at_10tpr", "fpr_at_20tpr", "tpr_at_1fpr", "tpr_at_5fpr")


def literal(rows):
    scores = sorted({s for s, _ in rows}, reverse=True)
    all_p, all_n = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    ratio = lambda a, b, empty=0.0: a / b if b else empty
    path = [(0, 0)]
    for s in scores:
        path.append((path[-1][0] + sum(y for x, y in rows if x == s), path[-1][1] + sum(1 - y for x, y in rows if x == s)))
    tpr, fpr = [ratio(t, all_p) for t, _ in path], [ratio(f, all_n) for _, f in path]
    precision = [1.0, *(ratio(t, t + f) for t, f in path[1:])]
    wins = sum((a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z)

    def fpr_at(at):
        if not all_p or not all_n:
            return 1.0
        i = max(k for k, t in enumerate(tpr) if t <= at)
        return fpr[i] if i + 1 == len(tpr) else fpr[i] + (at - tpr[i]) * (fpr[i + 1] - fpr[i]) / (tpr[i + 1] - tpr[i])

    def tpr_at(at):
        return max((t for t, f in list(zip(tpr, fpr, strict=True))[1:] if f <= at), default=0.0) if all_n else 0.0

    return {
        "auroc": wins / (all_p * all_n) if all_p and all_n else 0.5,
        "average_precision": sum((tpr[i] - tpr[i - 1]) * precision[i] for i in range(1, len(path))),
        "auprc": sum((tpr[i] - tpr[i - 1]) * (precision[i] + precision[i - 1]) / 2 for i in range(1, len(path))),
        "fpr_at_10tpr": fpr_at(0.9), "fpr_at_20tpr": fpr_at(0.8), "tpr_at_1fpr": tpr_at(0.01), "tpr_at_5fpr": tpr_at(0.05),
    }


def some_rows():
    rng = random.Random(5)
    for group in range(12):
        step = rng.choice([1, 7, 100])
        for _ in range(rng.choice([1, 2, 15, 80])):
            label = rng.choice([0, 1]) if group % 4 else group % 8 // 4
            yield group, round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * label, 0.2))) * step) / step, label


@pytest.mark.parametrize("slices", [4096, 3])
def test_bundle_equals_the_walk(spark, monkeypatch, slices):
    monkeypatch.setattr(metrics, "SLICES", slices)
    rows = list(some_rows())
    df = spark.createDataFrame([*rows, (0, 0.5, 7), (0, 0.5, None)], "g int, score double, label int").repartition(3)
    found = {r["g"]: r for r in metrics.bundle(df, ["g"]).join(metrics.auprc_trapezoid(metrics.curve(df, ["g"]), ["g"]), "g").collect()}
    for g in range(12):
        wanted = literal([(s, y) for h, s, y in rows if h == g])
        assert {c: found[g][c] for c in NAMES} == pytest.approx(wanted)
    whole = metrics.fpr_at_tpr(metrics.curve(df), 1.0).first()["fpr"]
    assert whole == pytest.approx(1.0)


def test_strata_by_grouping_sets(spark):
    rng = random.Random(6)
    rows = [(round(rng.random(), 2), rng.choice([0, 1, 1, None]), rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice([10, 149, 150, 900])) for _ in range(300)]
    df = spark.createDataFrame(rows, "score double, label int, domain string, source string, n_words int")
    for by_value in (False, True):
        found = metrics.stratified(df, ["domain", "source"], by_value=by_value)
        copied = metrics.bundle(metrics.strata(df, ["domain", "source"], by_value=by_value), ["stratum"])
        names = sorted(copied.columns)
        key = lambda r: r[names.index("stratum")]
        got, wanted = (sorted((tuple(r[c] for c in names) for r in x.collect()), key=key) for x in (found, copied))
        assert len(got) == (5 if by_value else 3)
        for a, b in zip(got, wanted, strict=True):
            assert a == pytest.approx(b)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Expand" in plan
    few = metrics.stratified(df.limit(5), ["domain"], least=10)
    assert few.count() == 0 and metrics.stratified(df.limit(0), ["domain"]).count() == 0


def test_nothing_to_rank(spark):
    none = spark.createDataFrame([], "score double, label int")
    assert metrics.bundle(none, []).first()["num_samples"] == 0
    odd = spark.createDataFrame([(float("nan"), 1), (None, 0), (0.5, 0), (0.5, 1)], "score double, label int")
    assert metrics.auroc(metrics.curve(odd)).first()["auroc"] == pytest.approx(0.875)
