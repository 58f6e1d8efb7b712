"""Per-text features as named Column expressions of a text column.

Every function takes the text (or an array derived from it once) and returns
a dict of feature name to Column.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from penmark.functions import lexicons as L
from penmark.functions import text as T


def entropy(words: Column, counts: Column) -> dict[str, Column]:
    """counts: the words' run lengths."""
    n = F.size(words).cast("double")
    bits = F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c.cast("double"))) / n
    return {"unigram_entropy": F.when(n > 0, bits).otherwise(0.0), "vocabulary_size": F.size(counts).cast("bigint")}


def repetition(words: Column) -> dict[str, Column]:
    """Sequences of words are told by 64-bit hashes within the text."""

    def share(n: int) -> Column:
        hashed = F.transform(words, lambda w: F.xxhash64(w))
        grams = T.bind(hashed, lambda own: F.transform(T.places(n - 1, F.size(own)), lambda i: F.xxhash64(*[F.get(own, i - k) for k in range(n)])))
        return T.bind(grams, lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0))

    out = {f"ngram_{n}_repetition": share(n) for n in (3, 4)}
    return out | {"word_count": F.size(words).cast("bigint")}


def richness(words: Column, counts: Column) -> dict[str, Column]:
    """counts: the words' run lengths."""
    n = F.size(words).cast("double")
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    return {
        "ttr": T.ratio(F.size(counts), n),
        "yules_k": T.ratio(10000.0 * (squares - n), n * n),
        "herdans_c": F.when(n > 1, (F.size(counts) - 1) / n).otherwise(0.0),
        "hapax_ratio": T.ratio(F.size(F.filter(counts, lambda c: c == 1)), n),
    }


def word_lengths(cased: Column) -> dict[str, Column]:
    lengths = F.transform(cased, lambda w: F.length(w).cast("double"))
    return {"avg_word_length": T.mean(lengths), "std_word_length": T.deviation(lengths, sample=True)}


#: Values of told_apart().
DISTINCT = ("ngram_3_repetition", "ngram_4_repetition", "ttr", "hapax_ratio")


def _told_apart(own: np.ndarray | None) -> tuple[float, ...]:
    if own is None or not len(own):
        return (0.0,) * len(DISTINCT)
    _, counts = np.unique(own, return_counts=True)
    out = []
    for n in (3, 4):
        many = len(own) - n + 1
        grams = np.zeros(max(0, many), dtype=np.uint64)
        for k in range(n if many > 0 else 0):
            grams = (grams ^ grams >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + own[k : k + many].view(np.uint64)
        out.append(1 - np.unique(grams).size / many if many > 0 else 0.0)
    return *out, counts.size / len(own), np.count_nonzero(counts == 1) / len(own)


def told_apart(words: Column) -> Column:
    """Values of repetition() and richness() that only ask which words are equal, as a struct: hashes sorted by numpy, a text at a time."""

    @F.pandas_udf(", ".join(f"{name} double" for name in DISTINCT))
    def of(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_told_apart(own) for own in rows], columns=list(DISTINCT), dtype="float64")

    return of(F.transform(words, lambda w: F.xxhash64(w)))


def sentence_sizes(text: Column) -> Column:
    return F.transform(T.sentences(text), lambda s: F.size(T.tokens(s)).cast("double"))


def sentence_lengths(text: Column, sizes: Column | None = None) -> dict[str, Column]:
    """sizes: those of the text's sentences, where they are there already."""
    sizes = sentence_sizes(text) if sizes is None else sizes
    return {
        "avg_sentence_length": T.mean(sizes),
        "std_sentence_length": T.deviation(sizes, sample=True),
        "max_sentence_length": F.coalesce(F.array_max(sizes), F.lit(0.0)),
        "min_sentence_length": F.coalesce(F.array_min(sizes), F.lit(0.0)),
    }


def readability(text: Column, cased: Column) -> dict[str, Column]:
    """Closed formulas; a syllable is a run of vowels, one at least in each word."""
    syllables = F.transform(cased, lambda w: F.greatest(F.regexp_count(F.lower(w), F.lit("[aeiouy]+")), F.lit(1)).cast("double"))
    n, sentences = F.size(cased).cast("double"), F.greatest(F.size(T.sentences(text)), F.lit(1)).cast("double")
    hard = F.size(F.filter(syllables, lambda s: s >= 3)).cast("double")
    by_word, by_sentence = T.ratio(T.total(syllables), n), n / sentences
    some = n > 0
    return {
        "flesch_kincaid_grade": F.when(some, 0.39 * by_sentence + 11.8 * by_word - 15.59).otherwise(0.0),
        "gunning_fog": F.when(some, 0.4 * (by_sentence + 100 * T.ratio(hard, n))).otherwise(0.0),
        "flesch_reading_ease": F.when(some, 206.835 - 1.015 * by_sentence - 84.6 * by_word).otherwise(0.0),
    }


def style(text: Column, words: Column) -> dict[str, Column]:
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    out = {
        "transition_phrase_freq": T.present(F.lower(text), L.TRANSITION_PHRASES) / n,
        "function_word_ratio": T.among(words, L.FUNCTION_WORDS) / n,
    }
    for w in L.COUNTED_FUNCTION_WORDS:
        counted = T.among(words, (w,)) / n if w in L.FUNCTION_WORDS else F.lit(0.0)
        out[f"function_word_{w}_ratio"] = counted
    return out


def punctuation(text: Column, words: Column) -> dict[str, Column]:
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    out = {f"punctuation_{name}_ratio": F.regexp_count(text, F.lit(pattern)) / n for name, pattern in L.PUNCTUATION.items()}
    out["quote_density"] = F.regexp_count(text, F.lit('"[^"]*"')) / n
    out["parenthetical_density"] = F.regexp_count(text, F.lit(L.PUNCTUATION["parenthetical"])) / n
    return out


#: Features of a tagger and a parser.
SYNTAX = ("pos_diversity", "dep_depth_mean", "dep_depth_max", "branching_factor_mean", "passive_ratio", "subordinate_density")


def syntax() -> dict[str, Column]:
    """Tag and dependency features without a tagger: constants, kept so that vectors keep their length."""
    return {name: F.lit(0.0) for name in SYNTAX}


def paragraph_shape(text: Column, own: Column | None = None) -> dict[str, Column]:
    """own: the text's paragraphs, where they are there already."""
    own = T.paragraphs(text) if own is None else own
    sizes = F.transform(own, lambda p: F.size(T.tokens(p)).cast("double"))
    several = F.size(own) >= 2
    cv = T.bind(sizes, lambda s: T.ratio(T.deviation(s, sample=True), T.mean(s)))
    first = F.transform(own, lambda p: F.lower(F.get(T.tokens(p), F.lit(0))))
    return {
        "paragraph_count": F.when(several, F.size(own)).otherwise(0).cast("bigint"),
        "paragraph_length_cv": F.when(several, cv).otherwise(0.0),
        "structure_regularity": F.when(several, 1 - F.least(F.lit(1.0), cv)).otherwise(0.0),
        "pattern_repetition": F.when(several, F.array_max(T.run_lengths(first)) / F.size(own)).otherwise(0.0),
    }


def transitions(text: Column) -> dict[str, Column]:
    counts = F.transform(T.sentences(F.lower(text)), lambda s: T.present(s, L.SENTENCE_TRANSITIONS).cast("double"))
    return {
        "transition_density": T.mean(counts),
        "transition_uniformity": T.bind(counts, lambda own: T.ratio(F.size(F.filter(own, lambda c: c > 0)), F.size(own))),
    }


def argument_flow(text: Column) -> dict[str, Column]:
    """Clause features without a parser: constants by the number of sentences."""
    return {"clause_complexity": F.when(F.size(T.terminated_sentences(text)) >= 2, 1.0).otherwise(0.0), "sentence_depth_cv": F.lit(0.0)}


def vocabulary_markers(words: Column) -> dict[str, Column]:
    return {"advanced_word_ratio": T.ratio(T.among(words, L.ADVANCED_WORDS), F.size(words))}


def cited(text: Column) -> Column:
    """The citations of a text, as they stand in it."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in L.CITATIONS])


def citations(text: Column, found: Column | None = None) -> dict[str, Column]:
    """found: the text's citations, where they are there already."""
    found = cited(text) if found is None else found
    suspicious = F.size(F.filter(found, lambda c: c.rlike(L.SUSPICIOUS_CITATION)))
    n = F.size(found)
    return {
        "citations_found": n.cast("bigint"),
        "citation_format_score": F.when(n > 0, (n - suspicious) / n).otherwise(0.5),
        "potential_hallucinations": F.when(n > 0, suspicious / n).otherwise(0.0),
    }


def academic_language(text: Column, cased: Column) -> dict[str, Column]:
    n = F.size(cased)
    latin = sum((F.regexp_count(text, F.lit(f"(?i){p}")) for p in L.LATIN_ABBREVIATIONS), F.lit(0))
    return {
        "avg_word_length": T.mean(F.transform(cased, lambda w: F.length(w).cast("double"))),
        "latin_abbreviation_ratio": T.ratio(latin, n),
        "passive_ratio": T.ratio(F.regexp_count(text, F.lit(f"(?i){L.PASSIVE}")), n),
    }


def claims(words: Column) -> dict[str, Column]:
    share = lambda listed: T.bind(F.array_distinct(words), lambda own: T.ratio(T.among(own, listed), F.size(own)))
    return {"hedging_ratio": share(L.HEDGING_WORDS), "certainty_ratio": share(L.CERTAINTY_WORDS)}


def code(text: Column) -> dict[str, Column]:
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"), F.lit(0)))
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")
    comments = F.size(F.filter(lines, lambda x: x.startswith("#") | x.startswith("//")))
    branches = F.regexp_count(text, F.lit(rf"\b({'|'.join(L.BRANCHING_KEYWORDS)})\b"))
    return {
        "low_entropy_variable_ratio": T.ratio(F.size(F.filter(names, lambda v: F.lower(v).isin(*L.VAGUE_NAMES))), F.size(names)),
        "comment_to_code_ratio": T.ratio(comments, F.size(lines) - comments),
        "logical_complexity": T.ratio(branches, F.size(lines)),
    }


def family_threshold(language: Column) -> tuple[Column, Column]:
    family = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in L.LANGUAGE_FAMILIES.items() for x in pair]), language), F.lit("other"))
    threshold = F.try_element_at(F.create_map(*[F.lit(x) for pair in L.FAMILY_THRESHOLDS.items() for x in pair]), family)
    return family, F.coalesce(threshold, F.lit(L.DEFAULT_FAMILY_THRESHOLD))


def multilingual(text: Column, language: Column) -> dict[str, Column]:
    own = T.unicode_words(text)
    pairs = T.bind(own, lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
    lengths = F.transform(own, lambda w: F.length(w).cast("double"))
    long_enough = F.filter(F.filter(F.split(text, r"[.!?]+"), lambda s: F.length(s) > 10), lambda s: T.strip(s) != "")
    sizes = F.transform(long_enough, lambda s: F.size(T.tokens(s)).cast("double"))
    family, threshold = family_threshold(language)
    return {
        "language_family": family,
        "family_threshold": threshold,
        "burstiness_cv": T.bind(sizes, lambda s: F.when(F.size(s) < 2, threshold).otherwise(T.ratio(T.deviation(s), T.mean(s)))),
        "char_bigram_diversity": T.bind(pairs, lambda p: T.ratio(F.size(F.array_distinct(p)), F.size(p))),
        "avg_word_length": T.mean(lengths),
        "word_length_variance": T.variance(lengths),
        "sentence_length_variance": T.variance(sentence_sizes(text)),
    }


def language(text: Column) -> Column:
    """The language with most stop words in the text, the first of equals; `unknown` without any."""
    own = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))

    def votes(words: Column) -> Column:
        return F.array(*[F.struct(T.among(words, listed).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, listed) in enumerate(L.STOP_WORDS.items())])

    some = lambda words: F.filter(words, lambda w: w.isin(*sorted({x for listed in L.STOP_WORDS.values() for x in listed})))
    return T.bind(F.array_max(T.bind(some(own), votes)), lambda best: F.when(best["n"] > 0, best["name"]).otherwise("unknown"))


def _stylometry(text: Column, words: Column, cased: Column, counts: Column, sizes: Column | None = None) -> dict[str, Column]:
    return richness(words, counts) | word_lengths(cased) | sentence_lengths(text, sizes) | readability(text, cased) | style(text, words)


def stylometry(text: Column) -> dict[str, Column]:
    """The features of boosted stylometry that need no model."""
    words = T.words(text)
    return _stylometry(text, words, T.cased_words(text), T.run_lengths(words))


def numbers(text: Column, made: Callable[[Column], dict[str, Column]] = stylometry) -> Column:
    """What `made` gives of a text as one map; for stylometry() words are found and counted once."""
    as_map = lambda named: F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), v.cast("double").alias("value")) for n, v in named.items()]))
    if made is not stylometry:
        return as_map(made(text))
    parts = F.struct(T.words(text).alias("words"), T.cased_words(text).alias("cased"), sentence_sizes(text).alias("sizes"))
    return T.bind(parts, lambda p: T.bind(T.run_lengths(p["words"]), lambda counts: as_map(_stylometry(text, p["words"], p["cased"], counts, p["sizes"]))))
