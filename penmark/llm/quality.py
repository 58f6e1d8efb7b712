"""Quality classifier by positive-unlabelled learning.

Minimises the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
over all trusted positives and all unlabelled training documents. A linear
scorer with the squared loss needs no more of them than their second moments,
and the logistic curve that turns its margins into probabilities, fitted by the
same risk, no more than two histograms. Both are sums of a fixed size, taken by
Spark over every row; no row is sampled. The class prior is estimated from
positives and unlabelled documents alone: the least ratio of their shares above
a threshold, with a margin for chance (best bin estimation).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.session import checkpointed, remainder, table
from penmark.llm.textbytes import NOT_SPACE, Words, pieces, string_buffer

PIECE_BYTES = 4_000_000
#: Trusted ids up to this number are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Margins are clipped to this and counted in so many bins.
MARGIN, BINS = 3.0, 2000
RIDGE = 0.05

#: Byte classes whose shares are features.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\t\r", ".", ",", "!?", "|", "*#%&$@^~", "\"'()-:;", "<>{}[]=+_/\\`")
_CLASS = np.full(256, len(_CLASSES), dtype=np.uint8)
for _i, _characters in enumerate(_CLASSES):
    _CLASS[list(_characters.encode())] = _i
_CLASS[128:] = len(_CLASSES) + 1
_N_CLASSES = len(_CLASSES) + 2


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    of_text = np.repeat(np.arange(n) * _N_CLASSES, size)
    shares = np.bincount(of_text + _CLASS[raw], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES) / np.maximum(size, 1)[:, None]

    words = Words(raw, offsets, NOT_SPACE)
    count = np.maximum(words.counts, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(words.text[flag], minlength=n) / count

    length = words.end - words.start
    mean = np.bincount(words.text, weights=length, minlength=n) / count
    spread = np.sqrt(np.maximum(np.bincount(words.text, weights=length.astype(float) ** 2, minlength=n) / count - mean**2, 0))
    same = np.zeros(words.hash.size, dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    key = np.sort(words.text.astype(np.uint64) << np.uint64(40) | words.hash >> np.uint64(24))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, dtype=np.int64)
    owner = (key[first] >> np.uint64(40)).astype(np.int64)
    times = np.diff(np.append(first, key.size))
    distinct = np.bincount(owner, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    last = _CLASS[raw[words.end - 1]] if length.size else np.zeros(0, np.uint8)
    begin = _CLASS[raw[words.start]] if length.size else np.zeros(0, np.uint8)
    derived = np.column_stack([
        np.log1p(words.counts), np.log1p(mean), np.log1p(spread), distinct / count, np.log1p(distinct), most / count,
        share(same), share(length <= 3), share(length >= 12), share(begin == 1), share((last >= 7) & (last <= 9)), share(length == 1),
    ])
    plain = np.concatenate([shares, derived], axis=1)
    return np.concatenate([plain, np.sqrt(plain)], axis=1)


N_FEATURES = 2 * (_N_CLASSES + 12)
_MIDDLES = (np.arange(BINS) + 0.5) * (2 * MARGIN / BINS) - MARGIN


@dataclass
class Scale:
    """Standardised features, at most 8 deviations from the centre, and a one for the bias."""

    centre: np.ndarray
    spread: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.centre) / self.spread, -8, 8), np.ones(len(x))])


@dataclass
class Model:
    scale: Scale
    weights: np.ndarray
    slope: float
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.clip(self.scale(x) @ self.weights, -MARGIN, MARGIN)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def moments(z: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Summed products of all rows, the unlabelled ones, then those of the trusted rows."""
    p = z[trusted]
    return np.concatenate([(z.T @ z).ravel(), (p.T @ p).ravel()])


def histograms(margin: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Rows in each bin of the margin: of all, then of the trusted."""
    at = ((np.clip(margin, -MARGIN, MARGIN) + MARGIN) * (BINS / (2 * MARGIN))).astype(int).clip(0, BINS - 1)
    return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[trusted], minlength=BINS)]).astype(float)


def _minimised(parts: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam over the non-negative risk; parts(w): the risk of negatives, its slope, the slope of the rest.

    While the estimated risk of negatives is below zero, its gradient is
    climbed instead, which is the correction that keeps the model from fitting
    the unlabelled positives.
    """
    w, m, v = start.astype(float), np.zeros(len(start)), np.zeros(len(start))
    for step in range(1, steps + 1):
        as_negative, slope_negative, slope_rest = parts(w)
        gradient = -slope_negative if as_negative < 0 else slope_negative + slope_rest
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def squared_risk(w: np.ndarray, unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the squared loss (1 - yz)^2 / 4, from mean products whose last row is the mean: see _minimised."""

    def against(products: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        pull = products @ w
        return (1 - 2 * sign * (products[-1] @ w) + w @ pull) / 4, (pull - sign * products[-1]) / 2

    (u, du), (p, dp), (_, rest) = against(unlabelled, -1), against(positive, -1), against(positive, 1)
    return u - prior * p, du - prior * dp, prior * rest


def logistic_risk(curve: np.ndarray, unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the logistic loss of slope * margin + shift, from shares of rows by bin: see _minimised."""
    z = curve[0] * _MIDDLES + curve[1]
    s, loss = 1 / (1 + np.exp(-np.clip(z, -60, 60))), np.logaddexp(0, z)
    base = np.stack([_MIDDLES, np.ones(BINS)])
    surplus = unlabelled - prior * positive
    return surplus @ loss, base @ (surplus * s), prior * (base @ (positive * (s - 1)))


def estimated_prior(unlabelled: np.ndarray, positive: np.ndarray, n_unlabelled: float, n_positive: float, *, miss: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among the unlabelled, from shares of both by bin of a margin.

    Above a threshold that few negatives pass, the share of the unlabelled is
    the prior times that of the positives; the threshold is the one of least
    ratio when both shares are given a margin for chance.
    """
    u, p = (np.cumsum(x[::-1]) for x in (unlabelled, positive))
    u, p = u[p > 0], p[p > 0]
    chance = np.sqrt(np.log(4 / miss) / 2) * (n_unlabelled**-0.5 + n_positive**-0.5)
    best = np.argmin((u + (1 + slack) * chance) / p)
    return float(min(1.0, u[best] / p[best]))


def _vectors(source: DataFrame) -> DataFrame:
    """id, and the features of text as array x."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffer(batch.column(1))
            for low, high in pieces(offsets, PIECE_BYTES):
                part = offsets[low : high + 1]
                x = features(raw[part[0] : part[-1]], part - part[0]).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], names=["id", "x"])

    return source.mapInArrow(computed, f"id {source.schema['id'].dataType.simpleString()}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(float)


def _totals(rows: DataFrame, size: int, measure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of measure(x, trusted), an array of `size`: by task, then by place."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += measure(_matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["place", "total"])

    sums = rows.select("trusted", "x").mapInArrow(summed, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(size)
    out[sums.column("place").to_numpy()] = sums.column("total").to_numpy()
    return out


def fit(rows: DataFrame) -> tuple[Model, float] | None:
    """The model and the estimated prior from rows (trusted, x); nothing without a trusted row."""
    sums = _totals(rows, 2 + 2 * N_FEATURES, lambda x, t: np.concatenate([[len(x), t.sum()], x.sum(axis=0), (x**2).sum(axis=0)]))
    n, n_trusted = sums[:2]
    if not n_trusted:
        return None
    centre, square = sums[2:].reshape(2, -1) / n
    scale = Scale(centre, np.sqrt(np.maximum(square - centre**2, 0)) + 1e-6)
    width = N_FEATURES + 1
    u, p = _totals(rows, 2 * width**2, lambda x, t: moments(scale(x), t)).reshape(2, width, width) / np.array([n, n_trusted])[:, None, None]

    def shares(w: np.ndarray) -> np.ndarray:
        return _totals(rows, 2 * BINS, lambda x, t: histograms(scale(x) @ w, t)).reshape(2, BINS) / np.array([n, n_trusted])[:, None]

    ridge = RIDGE * np.append(np.ones(N_FEATURES), 0)
    parting = np.linalg.solve((u + p) / 2 + np.diag(ridge) + 1e-9 * np.eye(width), (p[-1] - u[-1]) / 2)  # positives from unlabelled
    prior = estimated_prior(*shares(parting), n, n_trusted)

    def linear(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        negative, slope, rest = squared_risk(w, u, p, prior)
        return negative, slope, rest + ridge * w / 2

    weights = _minimised(linear, np.zeros(width), 800, 0.02)
    of_u, of_p = shares(weights)

    def curved(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        negative, slope, rest = logistic_risk(w, of_u, of_p, prior)
        return negative, slope, rest + np.array([1e-3 * w[0], 0])

    slope, shift = _minimised(curved, np.array([1.0, 0.0]), 2000, 0.05)
    return Model(scale, weights, float(slope), float(shift)), prior


def quality_scores(
    documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5
) -> DataFrame:
    """The probability that each text is of good quality: id_col, held_out, score.

    Trusted positives are the training rows that `labels` marks 1; unlabelled
    are all training documents, whatever their label; labels of 0 enter
    nothing. Fold 0 (crc32 of the id modulo `folds`) is held out. A document
    with several labels is trusted if the least is 1; null labels count not at
    all. Null texts are empty. Null ids are scored, never learnt from. Repeated
    rows count each. Without any trusted positive every score is 0.5. Other
    columns are not read.
    """
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    trusted = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .where(F.col("label").isNotNull() & (remainder("id", folds) > 0))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .where("label = 1")
        .select("id", F.lit(True).alias("trusted"))
    )
    if trusted.count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    rows = checkpointed(_vectors(source).join(trusted, "id", "left").select("id", F.coalesce("trusted", F.lit(False)).alias("trusted"), "x"))
    found = fit(rows.where(remainder("id", folds) > 0))
    sent = documents.sparkSession.sparkContext.broadcast(found[0] if found else None)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.score(_matrix(batch.column(1))) if sent.value else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    kind = source.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(scored, f"id {kind}, score double").select(
        F.col("id").alias(id_col), (remainder("id", folds) == 0).alias("held_out"), "score"
    )


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
