"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability in a language is summed over all its segmentations into
pieces by a forward algorithm, for all languages and many words at once (very
long words one by one in logarithms); a text is the product of its words. The piece probabilities are fitted by expectation
maximisation over the word counts of a bounded hash sample of each language's
training documents (`max_documents`).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.bpe import byte_characters, default_tokenizer
from penmark.llm.memory import give_back
from penmark.llm.session import remainder, table

MAX_DOCUMENTS = 3_000
ITERATIONS = 3
SMOOTHING = 0.05
#: Words of more bytes are summed one by one in logarithms, others many at a time.
LONGEST = 60
#: Words whose probabilities a worker keeps: the first that it meets, which include the frequent ones.
CACHED_WORDS = 300_000
#: Words whose segmentations are laid out at a time.
LATTICE_WORDS = 10_000
#: Every piece probability is multiplied by this for each of its bytes, so that a word of LONGEST bytes stays within a double.
_LIFT = 12.0
_WORD = re.compile(r"[^\W\d_]+")
_LETTER_BYTES = byte_characters()
#: The same but for the newline behind each word.
_LETTERS = {b: c for b, c in _LETTER_BYTES.items() if b != 10}
#: Bits for a piece's letters next to its number.
_LENGTH_BITS = 12


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower())


@dataclass
class Vocabulary:
    """Pieces of a byte-level vocabulary: those within a word, and those that end it."""

    inner: dict[str, int] = field(default_factory=dict)
    final: dict[str, int] = field(default_factory=dict)
    longest: int = 1
    automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}  # each worker builds its own

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        end, out = model["end_of_word_suffix"], cls()
        # Every single byte is a piece, so each word has a segmentation.
        for piece in [*_LETTER_BYTES.values(), *(c + end for c in _LETTER_BYTES.values()), *model["vocab"]]:
            own, name = (out.final, piece[: -len(end)]) if piece.endswith(end) else (out.inner, piece)
            if name and name not in own:
                own[name] = len(out.inner) + len(out.final)
                out.longest = max(out.longest, len(name))
        return out

    def occurrences(self, letters: str) -> np.ndarray:
        """Of words that each end in a newline, all pieces in them: (end in `letters`, piece, its letters), final pieces up to the newline."""
        if self.automaton is None:
            found = ahocorasick.Automaton()
            for own, end in ((self.inner, ""), (self.final, "\n")):
                for name, piece in own.items():
                    found.add_word(name + end, piece << _LENGTH_BITS | len(name))
            found.make_automaton()
            self.automaton = found
        packed = np.fromiter((end << 40 | code for end, code in self.automaton.iter(letters)), dtype=np.int64)
        return np.stack([packed >> 40, packed >> _LENGTH_BITS & (1 << 40 - _LENGTH_BITS) - 1, packed & (1 << _LENGTH_BITS) - 1])

    def __len__(self) -> int:
        return len(self.inner) + len(self.final)

    def lengths(self) -> np.ndarray:
        out = np.zeros(len(self), dtype=np.int64)
        for own in (self.inner, self.final):
            out[list(own.values())] = [len(p) for p in own]
        return out


class Lattice:
    """All pieces in some words: word, start, end and piece of each, by ascending end."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        letters = "".join([f"{w}\n" for w in words]).encode().decode("latin-1").translate(_LETTERS)
        breaks = np.flatnonzero(np.frombuffer(letters.encode("utf-16-le"), dtype=np.uint16) == 10)
        first = np.concatenate([[0], breaks[:-1] + 1]) if breaks.size else breaks
        self.size = breaks - first
        end, piece, length = vocabulary.occurrences(letters)
        word = np.searchsorted(breaks, end)
        final = breaks[word] == end
        end = end - first[word] + ~final  # of a piece's last letter the place behind it; a newline stands there already
        kept = final | (end < self.size[word])  # pieces within a word do not end it
        columns = np.stack([word, end - length, end, piece])[:, kept]
        self.word, self.start, self.end, self.piece = columns[:, np.argsort(columns[2], kind="stable")]
        self.by_start = np.argsort(self.start, kind="stable")
        self.longest = int(self.size.max(initial=0))

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Summed probability of each prefix: words x (length + 1) x languages."""
        alpha = np.zeros((len(self.size), self.longest + 1, probability.shape[1]))
        alpha[:, 0] = 1
        bounds = np.searchsorted(self.end, np.arange(self.longest + 2))
        for e in range(1, self.longest + 1):
            at = slice(bounds[e], bounds[e + 1])
            np.add.at(alpha[:, e], self.word[at], alpha[self.word[at], self.start[at]] * probability[self.piece[at]])
        return alpha

    def backward(self, probability: np.ndarray) -> np.ndarray:
        """Summed probability of each suffix, in the shape of forward()."""
        beta = np.zeros((len(self.size), self.longest + 1, probability.shape[1]))
        beta[np.arange(len(self.size)), self.size] = 1
        starts = self.start[self.by_start]
        bounds = np.searchsorted(starts, np.arange(self.longest + 2))
        for s in range(self.longest - 1, -1, -1):
            at = self.by_start[bounds[s] : bounds[s + 1]]
            np.add.at(beta[:, s], self.word[at], beta[self.word[at], self.end[at]] * probability[self.piece[at]])
        return beta

    def total(self, probability: np.ndarray) -> np.ndarray:
        return self.forward(probability)[np.arange(len(self.size)), self.size]

    def log_forward(self, log_probability: np.ndarray) -> np.ndarray:
        """forward() of a single word of any length, in logarithms: (length + 1) x languages."""
        alpha = np.full((self.longest + 1, log_probability.shape[1]), -np.inf)
        alpha[0] = 0
        bounds = np.searchsorted(self.end, np.arange(self.longest + 2))
        for e in range(1, self.longest + 1):
            at = slice(bounds[e], bounds[e + 1])
            alpha[e] = np.logaddexp.reduce(alpha[self.start[at]] + log_probability[self.piece[at]], axis=0)
        return alpha

    def log_backward(self, log_probability: np.ndarray) -> np.ndarray:
        """backward() likewise."""
        beta = np.full((self.longest + 1, log_probability.shape[1]), -np.inf)
        beta[-1] = 0
        bounds = np.searchsorted(self.start[self.by_start], np.arange(self.longest + 2))
        for s in range(self.longest - 1, -1, -1):
            at = self.by_start[bounds[s] : bounds[s + 1]]
            beta[s] = np.logaddexp.reduce(beta[self.end[at]] + log_probability[self.piece[at]], axis=0)
        return beta

    def uses(self, probability: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Expected uses of each edge of the lattice, where word i is of language k[i]."""
        alpha, beta = self.forward(probability), self.backward(probability)
        total, w = alpha[np.arange(len(self.size)), self.size], self.word
        own = k[w]
        return alpha[w, self.start, own] * probability[self.piece, own] * beta[w, self.end, own] / np.maximum(total[w, own], 1e-300)

    def log_uses(self, log_probability: np.ndarray, k: int) -> np.ndarray:
        """uses() of a single word of any length."""
        own = log_probability[:, [k]]
        alpha, beta = self.log_forward(own)[:, 0], self.log_backward(own)[:, 0]
        return np.exp(alpha[self.start] + own[self.piece, 0] + beta[self.end] - alpha[-1])


def _is_long(word: str) -> bool:
    return len(word) > LONGEST // 4 and len(word.encode()) > LONGEST


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    probability: np.ndarray  # pieces x languages, lifted
    vocabulary: Vocabulary
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    logs: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "scores": None, "logs": None}

    def log_probability(self) -> np.ndarray:
        if self.logs is None:
            self.logs = np.log(self.probability) - self.vocabulary.lengths()[:, None] * np.log(_LIFT)
        return self.logs

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log probability of each word in each language."""
        total = np.zeros((len(words), len(self.languages)))
        long = np.array([_is_long(w) for w in words], dtype=bool)
        short = np.flatnonzero(~long)
        for low in range(0, short.size, LATTICE_WORDS):
            own = short[low : low + LATTICE_WORDS]
            lattice = Lattice([words[i] for i in own], self.vocabulary)
            total[own] = np.log(np.maximum(lattice.total(self.probability), 1e-300)) - lattice.size[:, None] * np.log(_LIFT)
        for i in np.flatnonzero(long):
            total[i] = Lattice([words[i]], self.vocabulary).log_forward(self.log_probability())[-1]
        return total

    def text_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """log probability of each text in each language, prior included, and its number of words."""
        split = [words_of(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.known))
        place, scores, added = self.known, self.scores, {}
        if new:
            found = self.word_scores(new)
            scores = found if scores is None else np.concatenate([scores, found])
            added = dict(zip(new, range(len(place), len(place) + len(new)), strict=True))
            if len(place) < CACHED_WORDS:
                self.known.update(added)
                self.scores, added = scores, {}
        count = np.array([len(words) for words in split])
        out = np.tile(self.prior, (len(texts), 1))
        code = np.fromiter((place[w] if w in place else added[w] for words in split for w in words), dtype=np.int64, count=int(count.sum()))
        if code.size:
            owner = np.repeat(np.arange(len(texts)), count)
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(owner, weights=scores[code, k], minlength=len(texts))
        return out, count


def _word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) over all words of the sample."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = seen.setdefault(lang, Counter())
                own.update(words_of(text or ""))
            rows = [(lang, w, n) for lang, own in seen.items() for w, n in own.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "word", "n"), r, strict=True)) for r in rows], schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))
        give_back()

    return sample.mapInArrow(counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(counts: DataFrame, model: Model) -> pd.DataFrame:
    """Expected uses of each piece in each language; the result has a row for each used piece of the fixed vocabulary."""
    sent = counts.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        place = {lang: i for i, lang in enumerate(model.languages)}
        uses = np.zeros((len(model.vocabulary), len(model.languages)))
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            long = np.array([_is_long(w) for w in words], dtype=bool)
            if not long.all():
                lattice = Lattice([w for w, x in zip(words, long, strict=True) if not x], model.vocabulary)
                np.add.at(uses, (lattice.piece, lang[~long][lattice.word]), lattice.uses(model.probability, lang[~long]) * n[~long][lattice.word])
            for i in np.flatnonzero(long):
                lattice = Lattice([words[i]], model.vocabulary)
                np.add.at(uses[:, lang[i]], lattice.piece, lattice.log_uses(model.log_probability(), lang[i]) * n[i])
        piece, k = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(k, pa.int32()), pa.array(uses[piece, k])], names=["piece", "k", "uses"])
        give_back()

    return counts.mapInArrow(step, "piece int, k int, uses double").groupBy("piece", "k").agg(F.sum("uses").alias("uses")).toPandas()


def train(
    documents: DataFrame, *, id_col: str, text_col: str, lang_col: str, folds: int, max_documents: int, iterations: int, vocabulary_path: str | None
) -> Model:
    """Fits the piece probabilities on training rows (fold not 0) with a language and an id."""
    vocabulary = Vocabulary.load(vocabulary_path or default_tokenizer())
    rows = documents.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("id", folds) > 0)
    )
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(n)
    share = {lang: min(1.0, max_documents / n[lang]) for lang in languages}
    chosen = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1_000_000))
    limit = F.coalesce(*[F.when(F.col("lang") == lang, int(1_000_000 * share[lang])) for lang in languages], F.lit(0))
    prior = np.log(np.array([n[lang] for lang in languages], dtype=float) / max(1, sum(n.values())))
    lift = _LIFT ** vocabulary.lengths()[:, None].astype(float)
    model = Model(languages, prior, np.full((len(vocabulary), len(languages)), 1 / len(vocabulary)) * lift, vocabulary)
    if not languages:
        return model
    counts = _word_counts(rows.where(chosen < limit).select("lang", "text")).persist()
    try:
        for _ in range(iterations):
            found = _expected(counts, model)
            uses = np.full((len(vocabulary), len(languages)), SMOOTHING)
            uses[found["piece"], found["k"]] += found["uses"]
            model.probability, model.logs = uses / uses.sum(axis=0) * lift, None
    finally:
        counts.unpersist()
    return model


def identify_language(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    max_documents: int = MAX_DOCUMENTS,
    iterations: int = ITERATIONS,
    vocabulary_path: str | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The likeliest language of each text and its posterior probability.

    Returns for each row: id_col, the columns of `carry`, held_out (crc32 of the
    id modulo `folds` is 0), lang_pred and score. Learns from rows with a
    language and an id that are not held out; lang, source and id are no input
    of a prediction. A text that is null or has no letter is `und` with score
    0, as is every text if there is nothing to learn from. Equal scores go to
    the first language in the alphabet. Repeated rows are judged alike.
    """
    model = train(
        documents, id_col=id_col, text_col=text_col, lang_col=lang_col, folds=folds, max_documents=max_documents, iterations=iterations, vocabulary_path=vocabulary_path
    )
    sent = documents.sparkSession.sparkContext.broadcast(model)
    others = [c for c in carry if c != text_col]
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(others)])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = [*source_names, "lang_pred", "score"]
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                own = batch.slice(low, 500)
                texts = own.column(1).to_pylist()
                if not model.languages:
                    lang, score = ["und"] * len(texts), np.zeros(len(texts))
                else:
                    logs, count = model.text_scores(texts)
                    best = logs.argmax(axis=1)
                    top = logs[np.arange(len(texts)), best]
                    score = np.where(count > 0, 1 / np.exp(logs - top[:, None]).sum(axis=1), 0.0)
                    lang = [model.languages[b] if c else "und" for b, c in zip(best, count, strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lang, pa.string()), pa.array(score)], names=names)
        give_back()

    source_names = source.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)
    found = source.mapInArrow(predicted, f"{fields}, lang_pred string, score double")
    kept = [F.col("text" if c == text_col else f"carried_{others.index(c)}").alias(c) for c in carry]
    kept.insert(0, F.col("id").alias(id_col))
    return found.select(*kept, (remainder("id", folds) == 0).alias("held_out"), "lang_pred", "score")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
