"""Registered queries of the engine and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.functions import text as T
from penmark.operators import detectors, ensemble
from penmark.plans import evaluation, lexical, scoring

_REGISTERED = lexical.QUERIES | scoring.QUERIES | evaluation.QUERIES


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents get each label from their repetition scores: one scan, one small aggregation."""
    docs = lexical.documents(spark, folder).select("doc_id", T.words(F.col("text")).alias("w"))
    f = X.repetition(F.col("w"))
    scored = docs.select(detectors.repetition(f["ngram_3_repetition"], f["ngram_4_repetition"], f["word_count"], F.lit(0.0)).alias("r"))
    return scored.groupBy(ensemble.label(F.col("r.score"), F.col("r.confidence")).alias("label")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql}
