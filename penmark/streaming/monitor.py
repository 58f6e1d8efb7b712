"""Streams: row-wise detectors unchanged, and drift of a value over event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.functions import text as T
from penmark.operators import detectors, ensemble


def scored_stream(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds score, confidence and label of the repetition detector: no state, so batch and stream are the same."""
    f = X.repetition(T.words(F.col(text_col)))
    r = detectors.repetition(f["ngram_3_repetition"], f["ngram_4_repetition"], f["word_count"], F.lit(0.0))
    return texts.withColumn("r", r).withColumn("label", ensemble.label(F.col("r.score"), F.col("r.confidence"))).select("*", "r.score", "r.confidence").drop("r")


def drift(events: DataFrame, value: Column, ts_col: str = "ts", key_col: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n, mean) of a value in tumbling windows; rows more than `late` behind are dropped in streams."""
    source = events.withWatermark(ts_col, late) if events.isStreaming else events
    grouped = source.groupBy(F.window(ts_col, window).alias("w"), key_col).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return grouped.select(F.col("w.start").alias("window_start"), key_col, "n", "mean")
