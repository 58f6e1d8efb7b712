"""Token attributions by integrated gradients over a differentiable n-gram scorer.

The scorer is the logistic function of a mean over tokens: weights of single
tokens, and of adjacent tokens as products of both. Scaling all tokens by a
from 0 to 1 leads from the empty text to the text; along this path the scorer's
argument is bias + a * U + a^2 * B, for the text's sums U and B of weights. The
gradient with respect to one token, integrated over the path, is that token's
attribution; those of a text add up to its score less that of the empty text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions import text as T
from penmark.operators import external
from penmark.operators.detectors import Context, Detector
from penmark.operators.own_counts import own_counts, text_bytes

#: Points of the Gauss-Legendre rule in each panel of the path, and how far the scorer's argument may move in a panel.
POINTS = 16
PANEL = 8.0
#: Factor of the mean over tokens.
SCALE = 20.0
_KEY = "\u0001"


def _logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _grams(tokens: Column) -> Column:
    """array<struct<pos,token,pair>>: pair joins a token with the next, null at the end."""
    pair = lambda own, i: F.when(i + 1 < F.size(own), F.concat(F.get(own, i), F.lit(_KEY), F.get(own, i + 1)))
    return T.bind(tokens, lambda own: F.transform(own, lambda t, i: F.struct(i.alias("pos"), t.alias("token"), pair(own, i).alias("pair"))))


def _rows(units: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    each = F.explode(_grams(T.tokens(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    return units.select(id_col, *more, each.alias("g")).select(id_col, *more, "g.*")


@dataclass(frozen=True)
class NgramScorer:
    """weights (gram, weight) of tokens and of pairs of tokens, and the bias; a gram without a weight has 0."""

    weights: DataFrame
    bias: float
    scale: float = SCALE

    @classmethod
    def fit(cls, labelled: DataFrame, *, text_col: str = "text", label_col: str = "label", scale: float = SCALE) -> NgramScorer:
        """Log odds of each gram in texts of label 1 against label 0, one added to each count; the bias is that of the labels.

        Rows of another or no label are left out. Tokens and pairs are counted
        for themselves. A label that no text has makes all weights 0.
        """
        rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("label"), text_col)
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        grams = _rows(rows, "label", text_col).select("label", F.explode(F.array("token", "pair")).alias("gram")).where("gram IS NOT NULL")
        sums = grams.groupBy("gram").agg(*[F.count_if(F.col("label") == k).alias(f"n{k}") for k in (0, 1)])
        pair = F.contains("gram", F.lit(_KEY))
        totals = {r["pair"]: r for r in sums.groupBy(pair.alias("pair")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("v")).collect()}
        if len(counts) < 2:
            return cls(sums.select("gram", F.lit(0.0).alias("weight")), 0.0, scale)
        shift = {k: np.log(r["n0"] + r["v"]) - np.log(r["n1"] + r["v"]) for k, r in totals.items()}
        weight = F.log((F.col("n1") + 1) / (F.col("n0") + 1)) + F.when(pair, float(shift.get(True, 0.0))).otherwise(float(shift.get(False, 0.0)))
        return cls(sums.select("gram", weight.alias("weight")), float(np.log(counts[1] / counts[0])), scale)

    def _weighted(self, units: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, pos, token, own, both): the weights of each token and of it with the next, multiplied by the scale."""
        known = self.weights.select("gram", (F.col("weight") * self.scale).alias("w"))
        rows = _rows(units, id_col, text_col)
        tokens, pairs = known.where(~F.contains("gram", F.lit(_KEY))), known.where(F.contains("gram", F.lit(_KEY)))
        joined = rows.join(tokens.withColumnsRenamed({"gram": "token", "w": "own"}), "token", "left").join(pairs.withColumnsRenamed({"gram": "pair", "w": "both"}), "pair", "left")
        return joined.select(id_col, "pos", "token", F.coalesce("own", F.lit(0.0)).alias("own"), F.coalesce("both", F.lit(0.0)).alias("both"))

    def score(self, units: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score, n_tokens) of every text; without tokens, that of the bias. Ids must be unique and not null."""
        sums = self._weighted(units, id_col, text_col).groupBy(id_col).agg(F.sum(F.col("own") + F.col("both")).alias("z"), F.count("*").alias("n"))
        joined = units.select(id_col).join(sums, id_col, "left")
        score = _logistic(self.bias + F.coalesce(F.col("z") / F.col("n"), F.lit(0.0)))
        return joined.select(id_col, score.alias("score"), F.coalesce("n", F.lit(0)).alias("n_tokens"))

    def attributions(self, units: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, pos, token, attribution, score, baseline) of every token of every text.

        baseline is the score of the empty text. Texts without tokens have no
        rows. Ids must be unique and not null. After the joins with the weights
        a text's tokens meet in one row, where its integrals are taken once.
        """
        tokens = F.sort_array(F.collect_list(F.struct("pos", "token", "own", "both")))
        texts = self._weighted(units, id_col, text_col).groupBy(id_col).agg(
            tokens.alias("t"), F.count("*").alias("n"), (F.sum("own") / F.count("*")).alias("u"), (F.sum("both") / F.count("*")).alias("b")
        )

        def valued(integrals: Column) -> Column:
            def one(t: Column, i: Column) -> Column:
                both = t["both"] + F.coalesce(F.get("t", i - 1)["both"], F.lit(0.0))
                value = (t["own"] * integrals["flat"] + both * integrals["rising"]) / F.col("n")
                return F.struct(t["pos"].alias("pos"), t["token"].alias("token"), value.alias("attribution"))

            return F.transform("t", one)

        score = _logistic(self.bias + F.col("u") + F.col("b"))
        each = F.explode(T.bind(_path_integrals(F.lit(self.bias), F.col("u"), F.col("b")), valued))
        rows = texts.select(id_col, score.alias("score"), each.alias("v"))
        return rows.select(id_col, "v.pos", "v.token", "v.attribution", "score", _logistic(F.lit(self.bias)).alias("baseline"))


@dataclass(frozen=True)
class OwnNgramScorer:
    """The scorer that NgramScorer.fit() gives of those texts that `labels` (id, label) name, for all texts of the same table.

    Grams are told by 64-bit hashes and counted where they are scored; no table
    of weights is kept, and no token is shuffled. Ids must be unique.
    """

    labels: DataFrame
    label_col: str = "label"
    scale: float = SCALE

    def _weighted(self, units: DataFrame, id_col: str, text_col: str, attributed: bool = False) -> tuple[DataFrame, float]:
        """(id, text, own, both): arrays of the weights of each token and of it with the next, multiplied by the scale; and the bias.

        Or (id, text, attribution, score): of each token, and of its text.
        """
        sums = self.labels.groupBy(id_col).agg(*[F.count_if(F.col(self.label_col) == k).alias(f"n{k}") for k in (0, 1)])
        counts = units.select(id_col).join(sums, id_col).agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in (0, 1)]).first()
        fitted, scale = bool(counts["n0"] and counts["n1"]), self.scale
        bias = float(np.log(counts["n1"] / counts["n0"])) if fitted else 0.0

        def weights(lengths: np.ndarray, words: np.ndarray, pairs: np.ndarray, of_words: np.ndarray, of_pairs: np.ndarray) -> list[np.ndarray]:
            made = []
            for n, (types, n0, n1) in ((words, of_words), (pairs, of_pairs)):
                shift = np.log(n0 + types) - np.log(n1 + types) if types else 0.0
                made.append(np.where(fitted & (n.sum(axis=0) > 0), scale * (np.log((n[1] + 1) / (n[0] + 1)) + shift), 0.0))
            if not attributed:
                return made
            own, both = made
            text, n = np.repeat(np.arange(lengths.size), lengths), np.maximum(lengths, 1)
            u, b = (np.bincount(text, weights=w, minlength=lengths.size) / n for w in made)
            flat, rising = _integrals(bias, u, b)
            around = both + np.append(0.0, both[:-1]) if both.size else both  # the last token of a text has no pair
            return [(own * flat[text] + around * rising[text]) / n[text], _sigmoid(bias + u + b)[text]]

        split = lambda text: T.tokens(F.coalesce(text.cast("string"), F.lit("")))
        labelled = units.select(id_col, text_col).join(sums, id_col, "left")
        values = ("attribution", "score") if attributed else ("own", "both")
        found = own_counts(labelled, split, weights, values, id_col=id_col, text_col=text_col, times=("n0", "n1"), n_bytes=text_bytes(units, text_col))
        return found, bias

    def score(self, units: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score, n_tokens) of every text; without tokens, that of the bias."""
        rows, bias = self._weighted(units, id_col, text_col)
        z = F.when(F.size("own") > 0, (T.total(F.col("own")) + T.total(F.col("both"))) / F.greatest(F.size("own"), F.lit(1))).otherwise(0.0)
        return rows.select(id_col, _logistic(bias + z).alias("score"), F.size("own").cast("bigint").alias("n_tokens"))

    def attributions(self, units: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, pos, token, attribution, score, baseline) of every token of every text, as those of NgramScorer."""
        rows, bias = self._weighted(units, id_col, text_col, attributed=True)
        zipped = F.arrays_zip(T.tokens(F.col(text_col).cast("string")).alias("token"), "attribution", "score")
        # Outer, as no text here is empty: an inner one would have Spark split the texts once more for a filter on their size.
        each = rows.where(F.size("attribution") > 0).select(id_col, F.posexplode_outer(zipped).alias("pos", "v"))
        return each.select(id_col, "pos", "v.token", "v.attribution", "v.score", _logistic(F.lit(bias)).alias("baseline"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def _integrals(bias: float, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What _path_integrals() gives, of many texts at once."""
    x, w = np.polynomial.legendre.leggauss(POINTS)
    panels = 1 + np.floor((np.abs(u) + 2 * np.abs(b)) / PANEL).astype(np.int64)
    text = np.repeat(np.arange(u.size), panels)
    i = np.arange(text.size) - np.repeat(np.cumsum(panels) - panels, panels)
    a = (i[:, None] + (x + 1) / 2) / panels[text][:, None]
    s = _sigmoid(bias + a * u[text][:, None] + a * a * b[text][:, None])
    slope = s * (1 - s) * (w / 2) / panels[text][:, None]
    return np.bincount(text, weights=slope.sum(axis=1), minlength=u.size), np.bincount(text, weights=(slope * a).sum(axis=1), minlength=u.size)


def _path_integrals(bias: Column, u: Column, b: Column) -> Column:
    """Integrals over a of 0 to 1 of the logistic function's slope at bias + a u + a^2 b, plain (flat) and times a (rising).

    The path has as many panels as its length in the argument asks for.
    """
    x, w = np.polynomial.legendre.leggauss(POINTS)
    rule = F.array(*[F.struct(F.lit(float((a + 1) / 2)).alias("x"), F.lit(float(k / 2)).alias("w")) for a, k in zip(x, w, strict=True)])
    panels = (F.lit(1) + F.floor((F.abs(u) + 2 * F.abs(b)) / PANEL)).cast("int")

    def of_panel(i: Column) -> Column:
        def added(sums: Column, p: Column) -> Column:
            a = (i + p["x"]) / panels
            s = _logistic(bias + a * u + a * a * b)
            slope = s * (1 - s) * p["w"] / panels
            return F.struct((sums["flat"] + slope).alias("flat"), (sums["rising"] + slope * a).alias("rising"))

        return F.aggregate(rule, F.struct(F.lit(0.0).alias("flat"), F.lit(0.0).alias("rising")), added)

    parts = F.transform(F.sequence(F.lit(0), panels - 1), of_panel)
    return T.bind(parts, lambda own: F.struct(T.total(F.transform(own, lambda p: p["flat"])).alias("flat"), T.total(F.transform(own, lambda p: p["rising"])).alias("rising")))


def heatmap(attributions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, heatmap): each text's tokens in order with their shares of the sum of its attributions; 0.5 each where that is 0."""
    tokens = F.sort_array(F.collect_list(F.struct("pos", "token", "attribution")))
    rows = attributions.groupBy(id_col).agg(tokens.alias("t"), F.sum("attribution").alias("total"))
    share = lambda t: F.when(F.col("total") == 0, 0.5).otherwise(F.try_divide(t["attribution"], F.col("total")))
    return rows.select(id_col, F.transform("t", lambda t: F.struct(t["token"].alias("token"), share(t).alias("score"))).alias("heatmap"))


def detector(scorer: NgramScorer | OwnNgramScorer, name: str = "ngram_classifier") -> Detector:
    """The scorer as a detector; a text without tokens is an error."""

    def score(units: DataFrame, id_col: str, context: Context) -> DataFrame:
        found = scorer.score(units, id_col)
        s, c = external.classifier_score(F.lit("ai"), F.col("score"))
        none = F.col("n_tokens") == 0
        return found.select(id_col, F.when(none, 0.5).otherwise(s).alias("score"), F.when(none, 0.0).otherwise(c).alias("confidence"), F.when(none, "no token to score").alias("error"))

    return Detector(name, "medium", ("prose",), score)
