"""Plug-ins, surprisal features against plain arithmetic, the benchmark command, the policy of promotions."""

import json
import math
from importlib.metadata import EntryPoint

import pytest
from pyspark.sql import functions as F

from penmark import benchmarks, cli
from penmark.operators import detectors, lm


def register(catalog):
    catalog.register(detectors.Detector("own", "fast", ("prose",)))


def test_plugins_are_loaded_once_and_failures_noted(monkeypatch):
    points = [EntryPoint(n, f"{__name__}{v}", "penmark.detectors") for n, v in (("module", ""), ("function", ":register"), ("absent", ":nothing"))]
    points.append(EntryPoint("missing", "no_such_module_here", "penmark.detectors"))
    monkeypatch.setattr(detectors, "entry_points", lambda group: [p for p in points if p.group == group])
    catalog = detectors.Catalog()
    assert catalog.load_plugins() == ["function", "module"] and catalog.get("own").tier == "fast"
    assert set(catalog.failed) == {"absent", "missing"} and catalog.failed["missing"].startswith("ModuleNotFoundError")
    assert catalog.load_plugins() == [] and catalog.load_plugins(again=True) == ["function", "module"]
    assert catalog.load_plugins("another.group") == []


def _plain(s):
    n = len(s)
    if n < 2:
        return [0.0] * 5
    mean = sum(s) / n
    std = math.sqrt(sum((x - mean) ** 2 for x in s) / n)
    lagged = sum((a - mean) * (b - mean) for a, b in zip(s, s[1:])) / (n - 1)
    shares = [x / sum(s) for x in s]
    return [mean, std, std / mean, lagged / std**2 if n > 2 and std > 1e-10 else 0.0, -sum(p * math.log2(p) for p in shares if p > 0)]


def test_stylometric_surprisals_are_those_of_plain_arithmetic(spark):
    values = {1: [1.0, 4.0, 2.0, 8.0], 2: [3.0], 3: [], 4: [2.0, 2.0, 2.0], 5: [1.0, 5.0], 6: [0.0, 1e-4, 3.0, 0.0]}
    units = spark.createDataFrame([(i,) for i in values], "doc_id long")
    given = spark.createDataFrame([(i, p + 1, x) for i, s in values.items() for p, x in enumerate(s)], "doc_id long, pos int, surprisal double").orderBy(F.rand(3))
    found = {r["doc_id"]: list(r)[1:] for r in lm.stylometric_surprisals(units, given).collect()}
    assert set(found) == set(values)
    for i, s in values.items():
        assert found[i] == pytest.approx(_plain(s), abs=1e-9)


def _corpus(path, label):
    rows = [{"text": " ".join(f"w{'x' * (i % 3)} again and again" if i % 2 else f"word{chr(97 + k)} number" for k in range(12)), label: i % 2} for i in range(20)]
    path.write_text("\n".join(map(json.dumps, rows)))


def test_benchmark_command(spark, tmp_path):
    _corpus(tmp_path / "one.jsonl", "label")
    _corpus(tmp_path / "two.jsonl", "label")
    out = tmp_path / "report"
    given = [f"own={tmp_path / 'one.jsonl'}", f"mage={tmp_path / 'two.jsonl'}", f"lost={tmp_path / 'none.jsonl'}"]
    text = cli.main(["benchmark", *(x for g in given for x in ("--dataset", g)), "--detector", "repetition", "--detector", "stylometric", "--out", str(out)], spark)
    assert all(f"| {d} | {c} |" in text for d in ("repetition", "stylometric") for c in ("own", "mage"))
    assert "Skipped lost:" in text
    assert len(json.loads((out / "benchmark.json").read_text())["results"]) == 4
    assert len((out / "benchmark.csv").read_text().splitlines()) == 5 and (out / "benchmark.md").exists()
    for wrong in (["own"], [given[2]]):
        with pytest.raises(SystemExit):
            cli.main(["benchmark", "--dataset", *wrong, "--detector", "repetition"], spark)


def test_public_names():
    assert all(hasattr(benchmarks, name) for name in benchmarks.__all__)


def test_decisions_tell_their_policy(spark, tmp_path):
    score = lambda a: {"auroc": a, "f1": 0.5, "tpr_at_1fpr": 0.1}
    (tmp_path / "s.json").write_text(json.dumps({"dataset": "d", "results": {"x": {"before": score(0.6), "after": score(0.65)}}}))
    plain = cli.main(["promote", "--summary-path", str(tmp_path / "s.json")], spark)
    strict = cli.main(["promote", "--summary-path", str(tmp_path / "s.json"), "--min-auroc-gain", "0.1"], spark)
    found = [json.loads(t[t.index("{"):]) for t in (plain, strict)]
    assert [f["selected"] for f in found] == [["x"], []] and list(found[1]["rejected"]) == ["x"]
    assert [f["policy"]["min_auroc_gain"] for f in found] == [0.01, 0.1]
