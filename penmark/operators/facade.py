"""Whole documents: normalise, gate short texts, score chunks, and fold them back."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.functions import text as T
from penmark.operators import ensemble
from penmark.operators.detectors import Context, Detector, score_units
from penmark.operators.grains import chunked
from penmark.operators.own_counts import BLOCK_BYTES, text_bytes


def prepared(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = T.MIN_WORDS) -> DataFrame:
    """(id, raw, text, n_words, n_sentences, short): text is the normalised one, which has as many words as the raw text."""
    out = texts.select(id_col, F.col(text_col).alias("raw"), T.normalized(F.col(text_col)).alias("text"))
    spaces = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    out = out.withColumn("n_words", F.when(F.col("text") == "", 0).otherwise(spaces + 1).cast("bigint"))
    out = out.withColumn("n_sentences", F.size(T.terminated_sentences(F.col("text"))).cast("bigint"))
    short = F.coalesce((F.col("n_words") < least) | (F.col("n_sentences") == 0), F.lit(True))
    # Exploded, so that a filter on `short` is not pushed below and its texts are not normalised and split again there.
    once = F.explode(F.array(F.struct("text", "n_words", "n_sentences", short.alias("short"))))
    return out.select(id_col, "raw", once.alias("p")).select(id_col, "raw", "p.*")


def _units(ready: DataFrame, id_col: str, n_bytes: int) -> DataFrame:
    """(unit, text): the chunks of prepared() texts that have an id, dealt out once, so that detectors that read them apart don't cut them anew.

    Chunks without an id find no text again; a join would leave them out of some readers only, and these would not share the shuffle.
    """
    chunks = chunked(ready.where(~F.col("short") & F.col(id_col).isNotNull()), id_col).select(F.struct(id_col, "chunk_index").alias("unit"), "text")
    return chunks.repartition(max(ready.sparkSession.sparkContext.defaultParallelism, ceil(n_bytes / BLOCK_BYTES)), "unit")


def detect(
    texts: DataFrame, detectors: Sequence[Detector], context: Context, *, id_col: str = "doc_id", text_col: str = "text",
    strategy: str = "weighted_average", weights: dict[str, float] | None = None, least: int = T.MIN_WORDS, short_confidence: float = 0.3,
) -> DataFrame:
    """(id, score, confidence, label, n_chunks) of every text.

    A text of fewer than `least` words is uncertain at 0.5 and is not scored.
    Scores and confidences of the others are means over their chunks. Without
    detectors every text is uncertain at 0.5, long ones with no confidence.
    """
    ready = prepared(texts, id_col, text_col, least)
    if not detectors:
        unsure = F.when(F.col("short"), short_confidence).otherwise(0.0)
        return ready.select(id_col, F.lit(0.5).alias("score"), unsure.alias("confidence"), F.lit("uncertain").alias("label"), F.lit(0).cast("long").alias("n_chunks"))
    n_bytes = text_bytes(texts, text_col)
    scores = score_units(_units(ready, id_col, n_bytes), detectors, replace(context, n_bytes=n_bytes), "unit")
    by_chunk = ensemble.combine(scores, strategy, weights, "unit").select(F.col(f"unit.{id_col}").alias(id_col), "score", "confidence")
    by_text = by_chunk.groupBy(id_col).agg(F.avg("score").alias("s"), F.avg("confidence").alias("c"), F.count("*").alias("n_chunks"))
    joined = texts.select(id_col).join(by_text, id_col, "left")
    score, confidence = F.coalesce("s", F.lit(0.5)), F.coalesce("c", F.lit(short_confidence))
    chosen = F.when(F.col("s").isNull(), "uncertain").otherwise(ensemble.label(score, confidence))
    return joined.select(id_col, score.alias("score"), confidence.alias("confidence"), chosen.alias("label"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def results(
    texts: DataFrame, detectors: Sequence[Detector], context: Context, *, made: Callable[[Column], dict[str, Column]] = X.stylometry, heat: DataFrame | None = None,
    id_col: str = "doc_id", text_col: str = "text", strategy: str = "weighted_average", weights: dict[str, float] | None = None,
    least: int = T.MIN_WORDS, short_confidence: float = 0.3, most_tokens: int = 200, most_features: int = 20, top: int = 10,
) -> DataFrame:
    """All that is known of every text: what detect() returns, and detectors, features, top_features, heatmap and sentences.

    detectors: a map of each name to its mean score and confidence over the
    chunks and the error of the last chunk that has one. features: those that
    `made` gives of a text column, of the last chunk; top_features: the `top`
    of each chunk by absolute value, in the order of the chunks, the first
    `most_features`. heatmap and sentences: of `heat`, rows as heatmaps() takes
    them, else 0.5 for each token. Short texts have no detectors and features.
    Every detector runs once. Ids must be unique and not null.
    """
    ready = prepared(texts, id_col, text_col, least)
    n_bytes = text_bytes(texts, text_col)
    own = F.collect_list(F.struct("detector", "score", "confidence", "error")).alias("own")
    by_chunk = ensemble.combine(score_units(_units(ready, id_col, n_bytes), detectors, replace(context, n_bytes=n_bytes), "unit"), strategy, weights, "unit", own)
    by_text = by_chunk.select(F.col(f"unit.{id_col}").alias(id_col), "score", "confidence", F.struct(F.col("unit.chunk_index").alias("i"), "own").alias("chunk")).groupBy(id_col).agg(
        F.avg("score").alias("s"), F.avg("confidence").alias("c"), F.count("*").alias("n_chunks"), F.array_sort(F.collect_list("chunk"), lambda a, b: a["i"] - b["i"]).alias("chunks")
    )

    # Each chunk gives as many first features as there are, so only the first few chunks can reach the list; of the others only the last is asked.
    per_chunk = min(top, len(made(F.col("text"))))
    first = -(-most_features // per_chunk) if per_chunk > 0 else 0
    wanted = T.bind(T.chunks(F.col("text")), lambda all_: F.concat(F.slice(all_, 1, first), F.slice(all_, F.greatest(F.size(all_), F.lit(first + 1)), 1)))
    numbers = F.transform(wanted, lambda chunk: X.numbers(chunk["text"], made))
    last_and_first = T.bind(numbers, lambda all_: F.struct(
        F.get(all_, F.size(all_) - 1).alias("features"), F.slice(F.flatten(F.transform(F.slice(all_, 1, first), lambda own: importance(own, top))), 1, most_features).alias("top_features"),
    ))
    own_features = F.when(~F.col("short"), last_and_first)

    def of_detector(name: str, all_: Column) -> Column:
        mine = F.filter(all_, lambda x: x["detector"] == name)
        mean = lambda field: T.mean(F.transform(mine, lambda x: x[field]))
        errors = F.filter(F.transform(mine, lambda x: x["error"]), lambda e: e.isNotNull())
        return F.struct(F.lit(name).alias("key"), F.struct(mean("score").alias("score"), mean("confidence").alias("confidence"), F.get(errors, F.size(errors) - 1).alias("error")).alias("value"))

    all_ = F.flatten(F.transform("chunks", lambda x: x["own"]))
    names = list(dict.fromkeys(d.name for d in detectors))
    summed = by_text.select(
        id_col, "s", "c", "n_chunks",
        T.bind(all_, lambda a: F.map_from_entries(F.array(*[of_detector(n, a) for n in names]))).alias("detectors"),
    )
    joined = heatmaps(ready.withColumn("own_features", own_features), heat, id_col, most_tokens, ("short", "own_features")).join(summed, id_col, "left")
    scored = lambda name: F.when(F.col("s").isNotNull(), F.col("own_features")[name]).alias(name)
    score, confidence = F.coalesce("s", F.lit(0.5)), F.coalesce("c", F.when(F.col("short"), short_confidence).otherwise(0.0))
    chosen = F.when(F.col("s").isNull(), "uncertain").otherwise(ensemble.label(score, confidence))
    return joined.select(
        id_col, score.alias("score"), confidence.alias("confidence"), chosen.alias("label"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        "detectors", scored("features"), scored("top_features"), "heatmap", "sentences",
    )


def detector_means(scores: DataFrame, unit_col: str = "unit", id_col: str = "doc_id") -> DataFrame:
    """(id, detector, score, confidence, error): means over chunks; the error is that of the last chunk that has one."""
    return scores.groupBy(F.col(f"{unit_col}.{id_col}").alias(id_col), "detector").agg(
        F.avg("score").alias("score"), F.avg("confidence").alias("confidence"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col(f"{unit_col}.chunk_index"))).alias("error"),
    )


def joined_heatmap(parts: DataFrame, unit_col: str = "unit", id_col: str = "doc_id") -> DataFrame:
    """Rows (unit, position, heatmap) to (id, heatmap): concatenated over chunks, within one over detectors in order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(f"{unit_col}.chunk_index").alias("chunk"), "position", "heatmap")))
    return parts.groupBy(F.col(f"{unit_col}.{id_col}").alias(id_col)).agg(F.flatten(F.transform(ordered, lambda x: x["heatmap"])).alias("heatmap"))


def joined_features(parts: DataFrame, unit_col: str = "unit", id_col: str = "doc_id", most: int = 20) -> DataFrame:
    """Rows (unit, rank, feature, value) of the chunks' top features to (id, features): in the order of the chunks, the first `most`."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(f"{unit_col}.chunk_index").alias("chunk"), "rank", "feature", "value")))
    first = F.transform(F.slice(ordered, 1, most), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))
    return parts.groupBy(F.col(f"{unit_col}.{id_col}").alias(id_col)).agg(first.alias("features"))


def heatmaps(ready: DataFrame, parts: DataFrame | None = None, id_col: str = "doc_id", most: int = 200, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, *more, heatmap, sentences) of prepared() texts: the joined heatmap of `parts`, else 0.5 for each token.

    Sentences are scored over all tokens; only then the heatmap is cut to `most`.
    """
    rows = ready.select(id_col, *more, "text") if parts is None else ready.select(id_col, *more, "text").join(joined_heatmap(parts, id_col=id_col), id_col, "left")
    plain = token_heatmap(T.spaced_tokens(F.col("text")))
    rows = rows.select(id_col, *more, "text", (plain if parts is None else F.coalesce("heatmap", plain)).alias("heatmap"))
    return rows.select(id_col, *more, F.slice("heatmap", 1, most).alias("heatmap"), sentence_scores(F.col("heatmap"), sentence_bounds(F.col("text"), T.spaced_tokens)).alias("sentences"))


def token_heatmap(tokens: Column, scores: Column | None = None) -> Column:
    """array<struct<token,score>>, cut to the shorter; 0.5 for each token without scores."""
    if scores is None:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(0.5).alias("score")))
    n = F.least(F.size(tokens), F.size(scores))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(scores, 1, n), lambda t, s: F.struct(t.alias("token"), s.alias("score")))


def sentence_bounds(text: Column, tokens: Callable[[Column], Column] = T.tokens) -> Column:
    """array<struct<start,end>>: token positions of each sentence, running on."""
    sizes = F.transform(T.terminated_sentences(text), lambda s: F.size(tokens(s)))
    folded = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + n).alias("end")))).alias("out")),
    )
    return folded["out"]


def sentence_scores(heatmap: Column, bounds: Column) -> Column:
    """The mean score of the tokens of each sentence; 0.5 for an empty one or one out of range."""

    def one(tokens: Column, b: Column) -> Column:
        start, width = b["start"], F.least(b["end"], F.size(tokens)) - b["start"]
        inside = (start < F.size(tokens)) & (width > 0)
        return F.when(inside, T.mean(F.transform(F.slice(tokens, start + 1, F.greatest(width, F.lit(0))), lambda t: t["score"]))).otherwise(0.5)

    return T.bind(heatmap, lambda tokens: F.transform(bounds, lambda b: one(tokens, b)))


def colour(score: Column) -> Column:
    """A green ramp below 0.3, a red one above 0.7, grey between; fractions are cut off."""
    green = (200 * (0.3 - score) / 0.3).cast("int")
    strength = F.least(F.lit(1.0), (score - 0.7) / 0.3)
    rest = (255 * (1 - strength)).cast("int")
    return (
        F.when(score < 0.3, F.format_string("rgb(%d, 255, %d)", green, green))
        .when(score > 0.7, F.format_string("rgb(%d, %d, %d)", (255 * strength).cast("int"), rest, rest))
        .otherwise("rgb(230, 230, 230)")
    )


def heatmap_html(heatmap: Column) -> Column:
    """One span for each token in a div, a line each; tokens are not escaped."""
    spans = F.transform(
        heatmap, lambda t: F.format_string('<span style="background-color:%s" title="%.2f">%s</span>', colour(t["score"]), t["score"], t["token"])
    )
    return F.concat_ws("\n", F.lit('<div class="token-heatmap">'), spans, F.lit("</div>"))


def importance(features: Column, n: int = 10) -> Column:
    """The n entries of a map of numbers with the largest absolute values, as array<struct<key,value>>."""
    ordered = F.array_sort(F.transform(F.map_entries(features), lambda e: F.struct((-F.abs(e["value"])).alias("order"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.transform(F.slice(ordered, 1, n), lambda e: F.struct(e["key"].alias("feature"), e["value"].alias("importance")))
