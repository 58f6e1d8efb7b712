"""Benchmarks of detectors over several labelled datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.operators import calibrated
from penmark.operators.detectors import Context, Detector
from penmark.sources.datasets import Datasets, read


class Harness:
    """Loads datasets by name and measures detectors on them."""

    def __init__(self, spark: SparkSession, datasets: Datasets | None = None):
        self.spark, self.datasets = spark, datasets or Datasets()
        self.skipped: dict[str, str] = {}

    def load(self, name: str) -> DataFrame | None:
        """The rows (doc_id, text, label, meta); None if they can't be read, with the reason in `skipped`. An unknown name is an error."""
        dataset = self.datasets.get(name)
        try:
            # Ids are given to stored rows, which scoring and labels both read.
            rows = read(self.spark, dataset).withColumn("doc_id", F.monotonically_increasing_id()).persist()
            rows.count()
        except Exception as failure:  # whatever a source raises, the other datasets go on
            self.skipped[name] = str(failure).splitlines()[0]
            return None
        return rows

    def run(self, detectors: Sequence[Detector], context: Context, names: Sequence[str] | None = None) -> DataFrame | None:
        """The metrics, errors and seconds of each detector on each dataset that loads (all by default); None if none loads."""
        out = None
        for name in self.datasets.names() if names is None else names:
            rows = self.load(name)
            if rows is None:
                continue
            own = calibrated.measured(rows, detectors, context).withColumn("dataset", F.lit(name)).withColumn("stratum", F.lit("overall"))
            rows.unpersist()
            out = own if out is None else out.unionByName(own)
        return out
