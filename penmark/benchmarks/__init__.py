"""Datasets, the harness and reports, under one name."""

from penmark.plans.harness import Harness
from penmark.sources.datasets import DEFAULTS, Dataset, Datasets, labelled, read, sample
from penmark.sources.reports import leaderboard, markdown, pivoted, write_suite

__all__ = ["DEFAULTS", "Dataset", "Datasets", "Harness", "labelled", "leaderboard", "markdown", "pivoted", "read", "sample", "write_suite"]
