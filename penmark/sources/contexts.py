"""What detectors know besides a text, learnt from a corpus once and kept as Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.operators import grains, kneser_ney, lm
from penmark.operators.detectors import Context, ModelNotFoundError, Thresholds


def learnt(corpus: DataFrame, text_col: str = "text") -> Context:
    """Reference frequencies, the bigram and the trigram model of a corpus."""
    return Context(grains.reference_frequencies(corpus, text_col), lm.BigramModel.count(corpus, text_col=text_col), kneser_ney.KneserNey.count(corpus, text_col))


def save(context: Context, folder: str) -> None:
    """The tables of a context that has all three, below a folder that all of the cluster can write."""
    tables = {"reference": context.reference, "unigrams": context.model.unigrams, "bigrams": context.model.bigrams}
    tables |= {f"trigrams{k}": order.grams for k, order in enumerate(context.large.orders)}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, thresholds: Thresholds | None = None) -> Context:
    try:
        reference, unigrams, bigrams, *grams = (spark.read.parquet(f"{folder}/{n}") for n in ("reference", "unigrams", "bigrams", "trigrams0", "trigrams1", "trigrams2"))
    except AnalysisException as failure:
        raise ModelNotFoundError(f"no reference tables in {folder}") from failure
    model = lm.BigramModel(unigrams, bigrams, unigrams.agg(F.count("*").alias("v")))
    return Context(reference, model, kneser_ney.KneserNey.of_counts(grams), thresholds or Thresholds())
