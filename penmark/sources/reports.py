"""Sinks: suite reports, single results, promoted configurations."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a result row that reports show.
METRICS = ("auroc", "f1", "precision", "recall", "accuracy", "fpr_at_10tpr", "tpr_at_1fpr", "tpr_at_5fpr")


def leaderboard(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("auroc"), "detector")


def pivoted(results: DataFrame, strata: list[str]) -> DataFrame:
    """One row for each detector and dataset; columns strat_<stratum>_auroc and _f1 from its strata."""
    columns = [F.max(F.when(F.col("stratum") == s, F.col(m))).alias(f"strat_{s}_{m}") for s in strata for m in ("auroc", "f1")]
    overall = [F.max(F.when(F.col("stratum") == "overall", F.col(m))).alias(m) for m in METRICS if m in results.columns]
    return results.groupBy("detector", "dataset").agg(*overall, *columns)


def result_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))


def markdown(name: str, results: DataFrame) -> str:
    """A report of a suite: a summary table, then each result and its strata. Results are few: one for each detector, dataset and stratum."""
    rows = [r.asDict() for r in results.orderBy("dataset", "detector", "stratum").collect()]
    lines = [f"# {name}", "", "| detector | dataset | " + " | ".join(METRICS) + " |", "|" + "---|" * (2 + len(METRICS))]
    number = lambda v: "-" if v is None else f"{v:.4f}"
    for r in rows:
        if r["stratum"] == "overall":
            lines.append(f"| {r['detector']} | {r['dataset']} | " + " | ".join(number(r.get(m)) for m in METRICS) + " |")
    for r in rows:
        if r["stratum"] == "overall":
            lines += ["", f"## {r['detector']} on {r['dataset']}", "", f"Samples: {r['num_samples']}; confusion: tn {r['tn']}, fp {r['fp']}, fn {r['fn']}, tp {r['tp']}"]
            own = [s for s in rows if (s["detector"], s["dataset"]) == (r["detector"], r["dataset"]) and s["stratum"] != "overall"]
            lines += [f"- {s['stratum']}: AUROC {number(s['auroc'])}, F1 {number(s['f1'])}, {s['num_samples']} samples" for s in own]
    return "\n".join(lines) + "\n"


def write_suite(name: str, results: DataFrame, folder: str, formats: tuple[str, ...] = ("markdown", "json", "csv")) -> str:
    """Writes the report in the given formats below a folder of the driver and returns the Markdown."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    text = markdown(name, results)
    if "markdown" in formats:
        (out / f"{name}.md").write_text(text, encoding="utf-8")
    if "json" in formats:
        rows = [json.loads(r[0]) for r in results.select(F.to_json(F.struct("*"))).collect()]
        (out / f"{name}.json").write_text(json.dumps({"name": name, "results": rows}, indent=2, sort_keys=True), encoding="utf-8")
    if "csv" in formats:
        strata = [r[0] for r in results.where("stratum <> 'overall'").select("stratum").distinct().orderBy("stratum").collect()]
        pivoted(results, strata).toPandas().to_csv(out / f"{name}.csv", index=False)
    return text


def promoted_config(decisions: DataFrame, paths: dict[str, str], policy: Mapping[str, float | None] | None = None) -> tuple[str, str]:
    """The YAML of promoted calibrations and the JSON of all decisions and the policy that they follow; detectors are few."""
    rows = decisions.orderBy("detector").collect()
    chosen = [r["detector"] for r in rows if r["promoted"] and r["detector"] in paths]
    yaml = "\n".join(["# Promoted calibrations", "penmark:", "  detector_calibration_paths:", *(f"    {d}: {paths[d]}" for d in chosen)]) + "\n"
    rejected = {r["detector"]: list(r["reasons"]) or ["no artifact"] for r in rows if r["detector"] not in chosen}
    told = {"selected": chosen, "rejected": rejected} | ({"policy": dict(policy)} if policy else {})
    return yaml, json.dumps(told, indent=2, sort_keys=True)


def short_markdown(results: DataFrame) -> str:
    """One list item for each overall result."""
    rows = results.where("stratum = 'overall'").orderBy("dataset", "detector").collect() if "stratum" in results.columns else results.orderBy("detector").collect()
    items = [f"- {r['detector']}: AUROC {r['auroc']:.4f}, F1 {r['f1']:.4f}, {r['num_samples']} samples" for r in rows]
    return "\n".join(["# Results", "", *items]) + "\n"


def calibration_results(report: DataFrame, dataset: str) -> tuple[str, str]:
    """The JSON of a report (detector, before, after, delta) and its table as text; detectors are few."""
    rows = {r["detector"]: json.loads(r["m"]) for r in report.select("detector", F.to_json(F.struct("before", "after", "delta")).alias("m")).orderBy("detector").collect()}
    lines = [f"{'detector':<16}{'AUROC':>18}{'F1':>18}"]
    for name, m in rows.items():
        lines.append(f"{name:<16}" + "".join(f"{m['before'][c]:>9.4f}{m['after'][c]:>9.4f}" for c in ("auroc", "f1")))
    return json.dumps({"dataset": dataset, "results": rows}, indent=2, sort_keys=True), "\n".join(lines)
