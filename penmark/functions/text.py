"""Text projections as Column expressions: no shuffle, no Python but for NFC."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WINDOW_SIZE = 512
WINDOW_OVERLAP = 128
MIN_CHUNK_LENGTH = 50
MIN_WORDS = 150


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


#: The characters of the pattern (?U)\\s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any script at either end; only the ends are looked at."""
    return F.trim(text, F.lit(WHITE))


def normalized(text: Column) -> Column:
    """NFC, runs of white space as one space, stripped."""
    # Characters before U+0300 are composed as they are, so other texts need not meet Python.
    composed = F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\u02FF]"), text)), text)
    return strip(F.regexp_replace(composed, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Lower-case words of a-z only; tokens with digits, accents or underscores are no words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-zA-Z]+\b"), F.lit(0))


def cased_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z]+\b"), F.lit(0))


def unicode_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def spaced_tokens(text: Column) -> Column:
    """tokens() of a normalized text, or of a stripped piece of one, in which all white space is single spaces."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def _parts(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Stripped pieces between runs of . ! ? that are not empty."""
    return _parts(text, r"[.!?]+")


def terminated_sentences(text: Column) -> Column:
    """Sentences with their terminators: a rule that splits after . ! ? before white space.

    An approximation of a rule-based sentence splitter; abbreviations split too.
    """
    return _parts(F.regexp_replace(text, r"([.!?]+)(?U:\s+)", "$1\u0001"), "\u0001")


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    return _parts(text, separator)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: inside a lambda, a captured expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def places(first: int, end: Column) -> Column:
    """Positions first, first + 1, ... before `end`; none if there are none."""
    return F.when(end > first, F.sequence(F.lit(first), end - 1)).otherwise(F.array().cast("array<int>"))


def ngrams(items: Column, n: int) -> Column:
    """Contiguous n-grams, joined by spaces; none if there are fewer items."""
    return bind(items, lambda own: F.transform(places(1, F.size(own) - n + 2), lambda i: F.array_join(F.slice(own, i, n), " ")))


def chunks(text: Column, size: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP, least: int = MIN_CHUNK_LENGTH) -> Column:
    """Windows of characters as array<struct<text,start_char,end_char,chunk_index>>.

    A text of `least` characters or fewer is one chunk; the last window of a
    longer one is moved back so that it ends with the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap

    def cut(own: Column, length: Column) -> Column:
        count = F.when(length <= size, 0).otherwise(F.ceil((length - size) / F.lit(step)).cast("int"))
        width = F.least(length, F.lit(size))

        def one(i: Column) -> Column:
            start = F.least(i * step, F.greatest(F.lit(0), length - size))
            return F.struct(F.substring(own, start + 1, width).alias("text"), start.alias("start_char"), (start + width).alias("end_char"), i.alias("chunk_index"))

        return F.filter(F.transform(F.sequence(F.lit(0), count), one), lambda c: (length <= least) | (c["end_char"] - c["start_char"] >= least))

    return bind(text, lambda own: bind(F.length(own), lambda length: cut(own, length)))


def run_lengths(items: Column) -> Column:
    """How often each distinct item occurs, by sorting: n log n within the row."""
    return F.transform(counts(items), lambda c: c["n"])


def counts(items: Column) -> Column:
    """array<struct<item,n>>: the distinct items in order and how often each occurs."""

    def counted(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(places(0, n), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        ends = lambda own: F.concat(F.slice(own, 2, F.greatest(n, F.lit(1))), F.when(n > 0, F.array(n)).otherwise(F.array().cast("array<int>")))
        return bind(starts, lambda own: F.zip_with(own, ends(own), lambda a, b: F.struct(F.get(ordered, a).alias("item"), (b - a).alias("n"))))

    return bind(F.sort_array(items), counted)  # array_sort would call a comparator for each two items


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or `empty` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def _moments(values: Column) -> Column:
    """Number, mean and squared distances from the mean in one walk, each value by its distance from the running mean.

    A deviation that is a threshold is told from those beside it as in SQL, which sums in this way.
    """
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(a: Column, x: Column) -> Column:
        n, away = a["n"] + 1.0, x - a["mean"]
        middle = a["mean"] + away / n
        return F.struct(n.alias("n"), middle.alias("mean"), (a["squares"] + (x - middle) * away).alias("squares"))

    return F.aggregate(values, zero, step)


def mean(values: Column) -> Column:
    """0 if there are none."""
    return bind(values, lambda v: ratio(total(v), F.size(v)))


def variance(values: Column, sample: bool = False) -> Column:
    """Population variance (0 if empty), or the sample's (0 below two values)."""
    lost = 1.0 if sample else 0.0
    return bind(
        _moments(values),
        lambda m: F.when(m["n"] > lost, m["squares"] / (m["n"] - lost)).otherwise(0.0),
    )


def deviation(values: Column, sample: bool = False) -> Column:
    return F.sqrt(variance(values, sample))


def present(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases occur in the text."""
    out = F.lit(0)
    for phrase in phrases:
        out = out + F.contains(text, F.lit(phrase)).cast("int")
    return out


def among(items: Column, listed: tuple[str, ...]) -> Column:
    """How many items are listed."""
    return F.size(F.filter(items, lambda w: w.isin(*listed)))
