"""Languages by character trigrams: profiles counted from labelled texts, a text's language the one that makes its trigrams likeliest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions import text as T

UNKNOWN = "unknown"
#: A profile of at most this many trigrams is sent to all tasks.
BROADCAST_ROWS = 300_000
#: Each language is a column of the profile.
MOST_LANGUAGES = 500
#: A profile of few trigrams and at most this many languages goes to all tasks as arrays.
FEW_LANGUAGES = 20


def trigrams(text: Column) -> Column:
    """The character trigrams of lower-case words of letters, each word between spaces; a word of one letter has one."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))


def _spelled(text: Column) -> Column:
    """A text's lower-case words of letters with a space before, between and behind: its trigrams are those windows whose middle is no space."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"\P{L}+", " "), F.lit(" "))


#: A code point's bits in the number of a trigram.
_BITS = np.int64(21)


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of _spelled() texts as numbers, and each one's text."""
    whole = texts.to_pylist()
    points = np.frombuffer("".join(t or "" for t in whole).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of_text = np.repeat(np.arange(len(whole)), [len(t or "") for t in whole])
    middle = np.flatnonzero(points != 32)  # each text ends and begins with a space, so no window of a word leaves it
    return points[middle - 1] << 2 * _BITS | points[middle] << _BITS | points[middle + 1], of_text[middle]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Some texts at a time, so that a task's memory does not follow Arrow's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _gram(number: int) -> str:
    mask = (1 << int(_BITS)) - 1
    return "".join(chr(number >> int(_BITS) * k & mask) for k in (2, 1, 0))


def _gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of rows (lang, text): counted by task, then summed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in _slices(batches):
            numbers, of_text = _numbered(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs.tolist()):
                grams, n = np.unique(numbers[(langs == lang)[of_text]], return_counts=True)
                if lang in kept:
                    all_ = np.concatenate([kept[lang][0], grams])
                    grams, place = np.unique(all_, return_inverse=True)
                    n = np.bincount(place, weights=np.concatenate([kept[lang][1], n])).astype(np.int64)
                kept[lang] = grams, n
        for lang, (grams, n) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * grams.size, pa.string()), pa.array([_gram(g) for g in grams.tolist()], pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return rows.mapInArrow(counted, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Profiles:
    """gains: (gram, g0, g1, ...), log of one more than the gram's count in each language; bases: log shares of a count of one."""

    languages: tuple[str, ...]
    gains: DataFrame
    bases: tuple[float, ...]

    @classmethod
    def learn(cls, labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Profiles:
        """Profiles of the languages that rows name; rows without a language or text are left out."""
        rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), _spelled(F.col(text_col)).alias("text"))
        rows = _gram_counts(rows).persist()
        languages = tuple(sorted(r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()))
        if len(languages) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        if not languages:
            return cls((), rows.select("gram"), ())
        counts = rows.groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)])
        totals = counts.agg(F.count("*").alias("v"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))])
        row = totals.select(*[(-F.log(F.col(f"n{i}") + F.col("v"))).alias(f"b{i}") for i in range(len(languages))]).first()
        gains = counts.select("gram", *[F.log(F.col(f"n{i}") + 1.0).alias(f"g{i}") for i in range(len(languages))])
        return cls(languages, gains, tuple(row[f"b{i}"] for i in range(len(languages))))

    def identify(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, language, margin, n_trigrams): the likeliest language, and by how many nats a trigram it leads the second.

        Ties go to the first in alphabetical order. Texts that are null or
        without letters are `unknown`, with no margin; with one language it is
        0. Ids must be unique and not null.
        """
        if not self.languages:
            return texts.select(id_col, F.lit(UNKNOWN).alias("language"), F.lit(None).cast("double").alias("margin"), F.lit(0).cast("bigint").alias("n_trigrams"))
        few = self.gains.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        if few and len(self.languages) <= FEW_LANGUAGES:
            return self._ranked(self._summed(texts, id_col, text_col), id_col)
        rows = texts.select(id_col, F.explode_outer(trigrams(F.col(text_col))).alias("gram")).where("gram IS NOT NULL")
        met = rows.join(F.broadcast(self.gains) if few else self.gains, "gram", "left")
        sums = met.groupBy(id_col).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"g{i}"), F.lit(0.0)).alias(f"g{i}") for i in range(len(self.languages))])
        return self._ranked(texts.select(id_col).join(sums, id_col, "left"), id_col)

    def _summed(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, n, g0, g1, ...) of each text by its row alone: the number of its trigrams and the sums of their gains."""
        table = self.gains.toPandas()  # its rows were counted
        numbers = np.array([sum(ord(c) << int(_BITS) * (2 - k) for k, c in enumerate(g)) for g in table["gram"]], dtype=np.int64)
        order = np.argsort(numbers)
        known, names = numbers[order], [f"g{i}" for i in range(len(self.languages))]
        gains = [np.append(table[g].to_numpy()[order], 0.0) for g in names]  # the last for those that are not known

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                numbers, of_text = _numbered(batch.column(1))
                place = np.searchsorted(known, numbers)
                place[known[np.minimum(place, known.size - 1)] != numbers] = known.size
                sums = [np.bincount(of_text, weights=g[place], minlength=batch.num_rows) for g in gains]
                n = np.bincount(of_text, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *[pa.array(x, pa.float64()) for x in sums]], names=["id", "n", *names])

        kind = texts.schema[id_col].dataType.simpleString()
        schema = f"id {kind}, n bigint, " + ", ".join(f"{g} double" for g in names)
        return texts.select(F.col(id_col).alias("id"), _spelled(F.col(text_col)).alias("text")).mapInArrow(summed, schema).withColumnRenamed("id", id_col)

    def _ranked(self, sums: DataFrame, id_col: str) -> DataFrame:
        """What identify() gives, of rows (id, n, g0, g1, ...) of all texts; n is null or 0 without trigrams."""
        each = [F.struct((F.col(f"g{i}") + F.col("n") * base).alias("score"), F.lit(-i).alias("place"), F.lit(lang).alias("lang")) for i, (lang, base) in enumerate(zip(self.languages, self.bases, strict=True))]
        found = sums.select(id_col, F.when(F.col("n") > 0, F.col("n")).alias("n"), F.sort_array(F.array(*each), asc=False).alias("ranked"))
        first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
        lead = (first["score"] - F.coalesce(second["score"], first["score"])) / F.col("n")
        language = F.when(F.col("n").isNull(), UNKNOWN).otherwise(first["lang"])
        return found.select(id_col, language.alias("language"), lead.alias("margin"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_trigrams"))
