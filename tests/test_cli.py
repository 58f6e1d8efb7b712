import json

import pytest

from penmark import cli


def test_lists():
    assert "entropy\tfast\tprose,academic" in cli.main(["list-detectors"])
    assert cli.main(["list-datasets"]).split() == ["raid", "mage", "hc3", "m4"]


def test_detect(spark):
    out = json.loads(cli.main(["detect", "Too short."], spark))
    assert (out["score"], out["label"], out["confidence"]) == (0.5, "uncertain", 0.3)
    with pytest.raises(SystemExit):
        cli.main(["detect"], spark)


def test_evaluate_and_audit(spark, tmp_path):
    path = tmp_path / "corpus.jsonl"
    rows = [{"text": " ".join(f"w{'x' * (i % 3)} again and again" if i % 2 else f"word{chr(97 + k)} number" for k in range(12)), "label": i % 2} for i in range(20)]
    path.write_text("\n".join(map(json.dumps, rows)))
    out = cli.main(["evaluate", "--dataset", str(path), "--detector", "repetition"], spark)
    assert "| repetition |" in out and "confusion" in out
    assert "repetition/en" in cli.main(["audit", "--dataset", str(path), "-l", "en", "--detector", "repetition"], spark)
    assert "uncertainty_aware" in cli.main(["compare", "--dataset", str(path), "--detector", "repetition", "--detector", "stylometric"], spark)
