"""Tables below the grain of a text: words, n-grams, chunks, and reference frequencies."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions import text as T
from penmark.operators.looked_up import looked_up

#: References of at most this many words are sent to all tasks.
BROADCAST_ROWS = 20_000


def word_counts(units: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, n): exploded and counted, partially before the shuffle."""
    return units.select(id_col, F.explode(T.words(F.col(text_col))).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))


def reference_frequencies(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, q): relative frequencies of a reference corpus."""
    counts = corpus.select(F.explode(T.words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select("word", (F.col("n") / total).alias("q"))


def _divergences(text: np.ndarray, word: np.ndarray, q: np.ndarray, texts: int, floor: float) -> np.ndarray:
    """Of each text, from its words and the frequencies of the distinct ones."""
    keys, n = np.unique(text * max(1, q.size) + word, return_counts=True)
    text, word = keys // max(1, q.size), keys % max(1, q.size)
    q = np.log2(np.where(np.isnan(q), floor, q))
    total, own, other = (np.bincount(text, weights=w, minlength=texts) for w in (n, n * np.log2(n), n * q[word]))
    some = np.maximum(total, 1)
    return np.where(total > 0, (own - other) / some - np.log2(some), 0.0)


def kl_divergence(units: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", floor: float = 1e-10, n_bytes: int | None = None) -> DataFrame:
    """(id, kl_divergence) of every unit's words from the reference, in bits; 0 without words or reference.

    A small reference is sent to all tasks: words are counted in their row and
    meet a unit's other rows in one shuffle by unit. In a larger one they are
    looked up by packed blocks. Repeated ids are one unit. `n_bytes` is the size
    of the units' texts, if it is known.
    """
    size = reference.limit(BROADCAST_ROWS + 1).count()
    if size > BROADCAST_ROWS:
        found = looked_up(units, T.words, reference, "q", lambda *told: _divergences(*told, floor), id_col=id_col, text_col=text_col, n_bytes=n_bytes)
        return found.select(id_col, F.when(F.col(id_col).isNull(), 0.0).otherwise(F.col("q")).alias("kl_divergence"))
    rows = units.select(id_col, T.counts(T.words(F.col(text_col))).alias("c")).groupBy(id_col).agg(F.collect_list("c").alias("all"))
    again = lambda parts: F.flatten(F.transform(F.flatten(parts), lambda c: F.array_repeat(c["item"], c["n"])))
    merged = F.when(F.size("all") < 2, F.get("all", F.lit(0))).otherwise(T.counts(again(F.col("all"))))  # repeated ids are one unit
    counts = rows.select(id_col, F.inline(merged).alias("word", "n")).join(F.broadcast(reference), "word", "left")
    sums = counts.groupBy(id_col).agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("own"),
        F.sum(F.col("n") * F.log2(F.coalesce("q", F.lit(floor)))).alias("other"),
    )
    value = (F.col("own") - F.col("other")) / F.col("total") - F.log2(F.col("total").cast("double"))
    known = sums.select(id_col, value.alias("kl"))
    any_reference = F.lit(size > 0)
    return units.select(id_col).join(known, id_col, "left").select(id_col, F.when(any_reference, F.coalesce("kl", F.lit(0.0))).otherwise(0.0).alias("kl_divergence"))


def repeated_ngrams(units: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = (3, 4), least: int = 2, report: int = 5) -> DataFrame:
    """The n-grams of each unit that occur `least` times, by their share among those of their size.

    Each unit reports its `report` first; equal shares go by size, then text.
    They are counted in the row, so only those that recur meet a shuffle. Ids
    must be unique.
    """
    words = units.select(id_col, T.words(F.col(text_col)).alias("words"))
    grams = None
    for n in sizes:
        recur = lambda own: F.struct(F.size(own).alias("total"), F.filter(T.counts(own), lambda c: c["n"] >= least).alias("counts"))
        own = words.select(id_col, F.lit(n).alias("n"), T.bind(T.ngrams(F.col("words"), n), recur).alias("g"))
        own = own.select(id_col, "n", "g.total", F.inline("g.counts").alias("ngram", "count")).withColumn("count", F.col("count").cast("bigint"))
        grams = own if grams is None else grams.unionByName(own)
    ranked = grams.withColumn("share", F.col("count") / F.col("total")).groupBy(id_col)
    top = ranked.agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("order"), "n", "ngram", "count"))), 1, report).alias("top"))
    each = top.select(id_col, F.posexplode("top").alias("rank", "gram"))
    return each.select(id_col, (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("gram.n").cast("bigint").alias("n"), "gram.ngram", F.col("gram.count").alias("count"))


def chunked(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", **window: int) -> DataFrame:
    """(id, chunk_index, start_char, end_char, text) of every text's windows."""
    return texts.select(id_col, F.explode(T.chunks(F.col(text_col), **window)).alias("chunk")).select(
        id_col, "chunk.chunk_index", "chunk.start_char", "chunk.end_char", F.col("chunk.text").alias("text")
    )


def conversation_texts(turns: DataFrame) -> DataFrame:
    """(conv_id, text): the turns of each conversation as paragraphs."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "\n\n").alias("text"))


def _bleu(own: list[str], others: list[Counter], sizes: list[int], smoothing: float) -> float:
    """BLEU-4 of a paragraph against counted n-grams of others, of `sizes` words."""
    logs = 0.0
    for n in range(1, 5):
        have = Counter(zip(*(own[i:] for i in range(n)), strict=False))
        hits = sum(min(count, max(other[gram] for other in others)) for gram, count in have.items())
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or smoothing) / (len(own) - n + 1))
    closest = min(sizes, key=lambda size: (abs(size - len(own)), size))
    return (1.0 if len(own) > closest else math.exp(1 - closest / len(own))) * math.exp(logs / 4)


def own_bleu(text: Column, least: int = 5, others: int = 3, smoothing: float = 0.1) -> Column:
    """Mean BLEU-4 of each paragraph of a text against the first others, within the row: nothing is shuffled.

    Paragraphs and references of fewer than `least` tokens are left out. A size
    without matches counts `smoothing`; no common word at all, or fewer than
    two paragraphs, give 0. Only texts of several paragraphs meet Python.
    """

    def mean(paragraphs: list[list[str]]) -> float:
        # The first three others of paragraph i are among the first four of the text.
        long_ = [(i, list(p)) for i, p in enumerate(paragraphs) if len(p) >= least]
        grams = {i: Counter(g for n in range(1, 5) for g in zip(*(p[k:] for k in range(n)), strict=False)) for i, p in long_ if i <= others}
        found = []
        for i, p in long_:
            near = [j for j in grams if j != i and j - (j > i) < others]
            if near:
                found.append(_bleu(p, [grams[j] for j in near], [len(paragraphs[j]) for j in near], smoothing))
        return sum(found) / len(found) if found else 0.0

    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        return rows.map(lambda paragraphs: 0.0 if paragraphs is None or len(paragraphs) < 2 else mean(paragraphs)).astype("float64")

    several = F.when(F.contains(text, F.lit("\n\n")), F.transform(T.paragraphs(text), T.tokens))
    return of(several)


def self_bleu(units: DataFrame, id_col: str, text_col: str = "text", least: int = 5, others: int = 3, smoothing: float = 0.1) -> DataFrame:
    """(id, self_bleu) of every text, as own_bleu() has it."""
    return units.select(id_col, own_bleu(F.col(text_col), least, others, smoothing).alias("self_bleu"))
