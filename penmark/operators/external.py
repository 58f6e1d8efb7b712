"""Adapters of external models: what can be said of their replies without them.

A client is a function from a batch of prompts to replies; it runs in
mapInPandas and is given by the user. Without one the detectors of this kind
yield the standard error result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.operators.detectors import Detector

REPLY_CONFIDENCE = {"low": 0.4, "medium": 0.7, "high": 0.9}


def classifier_score(label: Column, probability: Column) -> tuple[Column, Column]:
    """Score and confidence from a class label and its probability; labels of human or real text count inversely."""
    return F.when(F.lower(label).rlike("human|real"), 1 - probability).otherwise(probability), F.least(F.lit(1.0), probability + 0.1)


def logprob_score(mean: Column) -> tuple[Column, Column]:
    """From the mean log probability of the tokens; none gives (0.5, 0.3)."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - mean / -10))
    return F.when(mean.isNull(), 0.5).otherwise(score), F.when(mean.isNull(), 0.3).otherwise(0.7)


def rating_score(reply: Column) -> Column:
    """A rating of 0 to 10 as 0 to 1; 0.5 if the reply is no number."""
    return F.coalesce(reply.try_cast("double") / 10, F.lit(0.5))


def perturbation_score(original: Column, perturbed: Column) -> tuple[Column, Column]:
    """From the rating of a text and the mean rating of its paraphrases; none gives (original, 0.3)."""
    difference = original - perturbed
    score = F.when(difference > 0.2, 0.8).when(difference > 0.1, 0.6).when(difference < -0.1, 0.3).otherwise(0.5)
    confidence = F.when(difference > 0.2, 0.7).when(difference > 0.1, 0.6).when(difference < -0.1, 0.5).otherwise(0.4)
    return F.when(perturbed.isNull(), original).otherwise(score), F.when(perturbed.isNull(), 0.3).otherwise(confidence)


def json_reply(reply: Column) -> Column:
    """struct<score,confidence,reasoning> from the braces in a reply; (0.5, 0) if they hold no JSON."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "score double, reasoning string, confidence string")
    level = F.lower(parsed["confidence"])
    confidence = F.lit(0.5)
    for name, value in REPLY_CONFIDENCE.items():
        confidence = F.when(level == name, value).otherwise(confidence)
    ok = parsed["score"].isNotNull()
    return F.struct(
        F.coalesce(parsed["score"], F.lit(0.5)).alias("score"), F.when(ok, confidence).otherwise(0.0).alias("confidence"), parsed["reasoning"].alias("reasoning")
    )


def escalation_prompt(text: Column, features: dict[str, Column], shown: int = 5) -> Column:
    """The question put to a reasoning model: the text and its first features, N/A where one is missing or 0."""
    lines = [F.concat(F.lit(f"- {name}: "), F.when(F.coalesce(value, F.lit(0.0)) == 0, "N/A").otherwise(value.cast("string"))) for name, value in list(features.items())[:shown]]
    return F.concat_ws("\n", F.lit("Was this text written by a person or by a language model? Answer in JSON with score, reasoning and confidence."), *lines, text)


def asked(rows: DataFrame, client: Callable[[list[str]], list[str | None]], id_col: str = "doc_id", prompt_col: str = "prompt") -> DataFrame:
    """(id, reply) of every prompt; a failed batch has null replies."""
    kind = rows.schema[id_col].dataType.simpleString()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                replies = client(batch["prompt"].tolist())
            except Exception:  # whatever a client raises is the reply's error
                replies = [None] * len(batch)
            yield pd.DataFrame({"id": batch["id"], "reply": replies})

    return rows.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt")).mapInPandas(ask, f"id {kind}, reply string").withColumnRenamed("id", id_col)


def attributed(scores: DataFrame, id_col: str = "doc_id", by: str = "sum") -> DataFrame:
    """Rows (id, pos, token, value) with value over its sum (gradients) or maximum (attention) in the text."""
    over = F.expr(f"{'sum' if by == 'sum' else 'max'}(value) OVER (PARTITION BY {id_col})")
    return scores.where(~F.col("token").isin("[CLS]", "[SEP]", "[PAD]", "<s>", "</s>", "<pad>")).withColumn("score", F.coalesce(F.try_divide(F.col("value"), over), F.lit(0.0)))


Client = Callable[[list[str]], list[str | None]]


def _outcome(replies: DataFrame, id_col: str, score: Column, confidence: Column) -> DataFrame:
    """Results of one reply each; a missing reply is the error result."""
    none = F.col("reply").isNull()
    return replies.select(
        id_col, F.when(none, 0.5).otherwise(score).alias("score"), F.when(none, 0.0).otherwise(confidence).alias("confidence"),
        F.when(none, F.lit("no reply")).alias("error"),
    )


def classifier(name: str, client: Client, domains: tuple[str, ...] = ("prose",)) -> Detector:
    """A detector by a classifier: a text's reply is JSON with label and probability."""

    def score(units: DataFrame, id_col: str, context: Context) -> DataFrame:
        parsed = F.from_json("reply", "label string, probability double")
        replies = asked(units.withColumn("prompt", F.col("text")), client, id_col).select(id_col, F.when(parsed["probability"].isNotNull(), F.col("reply")).alias("reply"))
        return _outcome(replies, id_col, *classifier_score(parsed["label"], parsed["probability"]))

    return Detector(name, "slow", domains, score)


def logprob(client: Client, domains: tuple[str, ...] = ("prose", "code")) -> Detector:
    """By mean log probabilities: a text's reply is that number; one that is no number gives (0.5, 0.3)."""

    def score(units: DataFrame, id_col: str, context: Context) -> DataFrame:
        return _outcome(asked(units.withColumn("prompt", F.col("text")), client, id_col), id_col, *logprob_score(F.col("reply").try_cast("double")))

    return Detector("llm_logprob", "slow", domains, score)


def perturbation(client: Client, paraphraser: Client, domains: tuple[str, ...] = ("prose",)) -> Detector:
    """By ratings of a text and of its paraphrases: the client rates 0 to 10, the paraphraser replies with a JSON list of texts."""

    def score(units: DataFrame, id_col: str, context: Context) -> DataFrame:
        rated = asked(units.withColumn("prompt", F.col("text")), client, id_col).select(id_col, "reply", rating_score(F.col("reply")).alias("original"))
        others = asked(units.withColumn("prompt", F.col("text")), paraphraser, id_col)
        each = others.select(F.col(id_col).alias("__of"), F.posexplode(F.from_json("reply", "array<string>")).alias("i", "prompt"))
        keyed = each.select(F.struct("__of", "i").alias("key"), "prompt")
        means = asked(keyed, client, "key").groupBy(F.col("key.__of").alias("__of")).agg(F.avg(rating_score(F.col("reply"))).alias("perturbed"))
        joined = rated.join(means, F.col(id_col) == F.col("__of"), "left")
        return _outcome(joined, id_col, *perturbation_score(F.col("original"), F.col("perturbed")))

    return Detector("llm_perturbation", "slow", domains, score)


def reasoning(client: Client, made: Callable[[Column], dict[str, Column]] = X.stylometry, domains: tuple[str, ...] = ("prose",)) -> Detector:
    """By a reasoning model's answer to escalation_prompt()."""

    def score(units: DataFrame, id_col: str, context: Context) -> DataFrame:
        replies = asked(units.withColumn("prompt", escalation_prompt(F.col("text"), made(F.col("text")))), client, id_col)
        answer = json_reply(F.col("reply"))
        return _outcome(replies, id_col, answer["score"], answer["confidence"])

    return Detector("llm_reasoning", "slow", domains, score)
