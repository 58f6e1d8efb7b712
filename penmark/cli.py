"""Command line: detect, evaluate, compare, audit, promote, and what is available."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.functions import text as T
from penmark.operators import boosting, calibrated, calibration, detectors, ensemble, facade, metrics
from penmark.plans import harness
from penmark.sources import config, contexts, datasets, reports


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="penmark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    detect = commands.add_parser("detect", help="score one text or a file of one text")
    detect.add_argument("text", nargs="?")
    detect.add_argument("--file")
    detect.add_argument("--strategy", default="weighted_average")
    evaluate = commands.add_parser("evaluate", help="metrics of detectors on a JSON-lines corpus")
    compare = commands.add_parser("compare", help="metrics of the ensemble strategies on a JSON-lines corpus")
    audit = commands.add_parser("audit", help="false positives by language tag on a JSON-lines corpus")
    audit.add_argument("-l", "--language", action="append", required=True)
    for command in (evaluate, compare, audit):
        command.add_argument("--dataset", required=True)
    train = commands.add_parser("train", help="fit boosted stylometry on a JSON-lines corpus and save it")
    train.add_argument("--dataset", required=True)
    train.add_argument("--out", required=True)
    learn = commands.add_parser("reference", help="learn reference frequencies and language models from a JSON-lines corpus and save them")
    learn.add_argument("--dataset", required=True)
    learn.add_argument("--out", required=True)
    calibrate = commands.add_parser("calibrate", help="fit calibrations on a JSON-lines corpus, save them, and report before and after")
    against = commands.add_parser("calibration-compare", help="saved calibrations against the plain detectors on a JSON-lines corpus")
    saved = commands.add_parser("calibration-evaluate", help="metrics of saved calibrations on a JSON-lines corpus")
    for command in (calibrate, against, saved):
        command.add_argument("--dataset", required=True)
        command.add_argument("--folder", default="calibration_models")
        command.add_argument("--detector", action="append", required=True)
    promote = commands.add_parser("promote", help="gate calibrations by a summary of metrics")
    promote.add_argument("--summary-path", required=True)
    promote.add_argument("--folder", default="calibration_models")
    promote.add_argument("--min-auroc-gain", type=float, default=0.01)
    promote.add_argument("--max-f1-loss", type=float, default=0.0)
    promote.add_argument("--min-tpr-gain", type=float)
    suite = commands.add_parser("benchmark", help="metrics of detectors on several corpora, written as a report")
    suite.add_argument("--dataset", action="append", required=True, metavar="NAME=PATH", help="a known name gives the fields; others have text and label")
    suite.add_argument("--format", default="json", help="of the files, as Spark names it")
    suite.add_argument("--name", default="benchmark")
    suite.add_argument("--out", help="a folder for Markdown, JSON and CSV")
    commands.add_parser("list-detectors")
    commands.add_parser("list-datasets")
    for command in (detect, evaluate, compare, audit, suite):
        command.add_argument("--detector", action="append", help="names; all of the fast tier by default")
        command.add_argument("--config")
    for command in (detect, evaluate, compare, audit, calibrate, against, saved, suite):
        command.add_argument("--reference", help="a folder of the command `reference`; without it, entropy and surprisal detectors have no result")
    return parser


def _context(spark: SparkSession, args: argparse.Namespace) -> detectors.Context:
    """The saved reference; without one, detectors that need it give their error result."""
    return contexts.load(spark, args.reference) if args.reference else detectors.Context()


def _chosen(names: Sequence[str] | None) -> list[detectors.Detector]:
    catalog = detectors.default_catalog()
    chosen = catalog.select(names) if names else [d for d in catalog.select(tier="fast") if d.score]
    if not chosen:
        sys.exit("no such detector")
    return chosen


def _corpus(spark: SparkSession, path: str) -> DataFrame:
    return datasets.jsonl(spark, path).withColumn("doc_id", F.monotonically_increasing_id()).persist()


def detect(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> str:
    if not args.text and not args.file:
        sys.exit("a text or a file is needed")
    rows = spark.createDataFrame([(args.text,)], "text string") if args.text else datasets.whole_text(spark, args.file)
    rows = rows.withColumn("doc_id", F.lit(0))
    chosen = _chosen(args.detector)
    known = facade.results(
        rows, chosen, _context(spark, args), strategy=args.strategy, weights=settings.ensemble.weights, least=settings.min_text_length, short_confidence=settings.short_text_confidence,
        most_tokens=settings.max_heatmap_tokens, most_features=settings.max_top_features,
    )
    columns = ("score", "label", "confidence", "n_chunks", "detectors", "sentences", "top_features", "features", "heatmap")
    return known.select(reports.result_json(*columns)).first()[0]


def reference(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> str:
    contexts.save(contexts.learnt(_corpus(spark, args.dataset)), args.out)
    return f"saved {args.out}"


def evaluate(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> str:
    corpus = _corpus(spark, args.dataset)
    metrics.require_both_classes(corpus)
    scores = detectors.score_units(corpus, _chosen(args.detector), _context(spark, args))
    rows = scores.join(corpus.select("doc_id", "label", F.size(T.tokens(F.col("text"))).alias("n_words")), "doc_id").withColumn("overall", F.lit(1))
    strata = metrics.strata(rows, ["overall"], least=1)
    found = metrics.bundle(strata, ["detector", "stratum"]).withColumn("dataset", F.lit(args.dataset))
    return reports.markdown("evaluation", found)


def compare(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> str:
    corpus = metrics.split(_corpus(spark, args.dataset), "doc_id")
    metrics.require_both_classes(corpus)
    test = corpus.where("split = 'test'")
    scores = detectors.score_units(test, _chosen(args.detector), _context(spark, args)).persist()
    parts = [ensemble.combine(scores, s, settings.ensemble.weights).withColumn("detector", F.lit(s)).select("doc_id", "detector", "score") for s in ("mean", "weighted_average", "uncertainty_aware")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(test.select("doc_id", "label"), "doc_id").withColumn("stratum", F.lit("overall"))
    return reports.markdown("strategies", metrics.bundle(rows, ["detector", "stratum"]).withColumn("dataset", F.lit(args.dataset)))


def audit(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> str:
    corpus = datasets.tagged(_corpus(spark, args.dataset), "doc_id", args.language)
    scores = detectors.score_units(corpus, _chosen(args.detector), _context(spark, args)).join(corpus.select("doc_id", "label", "language"), "doc_id")
    found = metrics.fpr_by_group(scores.withColumn("group", F.concat_ws("/", "detector", "language")), "group").orderBy("group")
    return "\n".join(f"{r['group']}: {r['fpr']:.4f} of {r['n']}" for r in found.collect())


def train(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> str:
    corpus = _corpus(spark, args.dataset)
    metrics.require_both_classes(corpus)
    made = X.stylometry(F.col("text"))
    model = boosting.train(corpus.select("label", *[c.cast("double").alias(n) for n, c in made.items()]), list(made))
    boosting.save(model, list(made), args.out)
    return f"saved {args.out}: {model.getNumTrees} trees over {len(made)} features"


def calibrate(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> str:
    corpus = _corpus(spark, args.dataset)
    _, report = calibrated.train(corpus, args.detector, detectors.default_catalog(), _context(spark, args), folder=args.folder)
    return "\n".join(reports.calibration_results(report, args.dataset))


def _saved(spark: SparkSession, args: argparse.Namespace) -> dict[str, calibration.Calibrator]:
    where = {d: calibrated.discovered(spark, args.folder, [d]) for d in args.detector}
    found = {d: calibrated.loaded(path) for d, path in where.items() if path}
    if not found:
        sys.exit("no such calibration")
    return found


def calibration_compare(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> str:
    corpus = _corpus(spark, args.dataset)
    return reports.calibration_results(calibrated.compare(corpus, _saved(spark, args), detectors.default_catalog(), _context(spark, args)), args.dataset)[1]


def calibration_evaluate(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> str:
    corpus, known = _corpus(spark, args.dataset), _saved(spark, args)
    return reports.short_markdown(calibrated.measured(corpus, [calibrated.bound(d, known[d.name]) for d in detectors.default_catalog().select(list(known))], _context(spark, args)))


def promote(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> str:
    policy = {"min_auroc_gain": args.min_auroc_gain, "max_f1_loss": args.max_f1_loss, "min_tpr_gain": args.min_tpr_gain}
    decided = calibration.promotion_reasons(datasets.promotion_summary(spark, args.summary_path), **policy)
    paths = {r["detector"]: calibration.artifact_path(args.folder, r["detector"], "calibration") for r in decided.select("detector").collect()}
    return "\n".join(reports.promoted_config(decided, paths, policy))


def benchmark(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> str:
    """One report of all corpora that can be read; the others are listed with the reason."""
    known, names = datasets.Datasets(), []
    for given in args.dataset:
        name, _, path = given.partition("=")
        if not path:
            sys.exit("--dataset takes NAME=PATH")
        own = known.get(name) if name in known.names() else datasets.Dataset(name)
        known.register(replace(own, path=path, format=args.format))
        names.append(name)
    suite = harness.Harness(spark, known)
    found = suite.run(_chosen(args.detector), _context(spark, args), names)
    if found is None:
        sys.exit("no corpus could be read: " + "; ".join(f"{n}: {why}" for n, why in suite.skipped.items()))
    text = reports.write_suite(args.name, found, args.out) if args.out else reports.markdown(args.name, found)
    return text + "".join(f"\nSkipped {n}: {why}" for n, why in suite.skipped.items())


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    args = _parser().parse_args(argv)
    if args.command == "list-detectors":
        out = "\n".join(f"{d.name}\t{d.tier}\t{','.join(d.domains)}" for d in detectors.default_catalog().select())
    elif args.command == "list-datasets":
        out = "\n".join(datasets.Datasets().names())
    else:
        spark = spark or SparkSession.builder.appName("penmark").getOrCreate()
        settings = config.resolve(getattr(args, "config", None))
        out = {"detect": detect, "evaluate": evaluate, "compare": compare, "audit": audit, "promote": promote, "train": train, "reference": reference, "calibrate": calibrate,
               "calibration-compare": calibration_compare, "calibration-evaluate": calibration_evaluate, "benchmark": benchmark}[args.command](spark, args, settings)
    print(out)
    return out


if __name__ == "__main__":
    main()
