"""Sentences whose ends are told from the periods of abbreviations, which are learnt from the corpus.

A type of token is an abbreviation if a period follows it far more often than
periods follow tokens at all, by the likelihood ratio of the two readings,
weakened for long types and for types that also stand without a period. After
an abbreviation a sentence ends only where the next word is capitalised, is
also seen in lower case and as the first of a sentence, and is never
capitalised inside one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions import text as T

#: Least score of an abbreviation, and the share of periods that follow one.
LEAST_SCORE = 0.3
ABBREVIATED = 0.99
#: Tables of at most this many rows are sent to all tasks.
BROADCAST_ROWS = 200_000
#: Distinct tokens that a task holds before it hands their counts on.
DISTINCT_TOKENS = 200_000

_OPENING = r"""^[("'\[«“‘]+"""
_CLOSING = r"""[)"'\],;:»”’]+$"""
_WORD = r"^\p{L}[\p{L}.'’-]*$"
_END = r"""[.!?]+[)"'\]»”’]*$"""
_SURE_END = r"""[!?]+[)"'\]»”’]*$"""
_SURE, _MAYBE, _SPACE, _CONTROL = re.compile(_SURE_END), re.compile(_END), re.compile(f"[{T.WHITE}]+"), re.compile(r"[\x1c-\x1f]")
_NUMBER = r"^[0-9]+([.,][0-9]+)*\.$"


def _core(token: Column) -> Column:
    """A token without quotes, brackets and commas around it."""
    return F.regexp_replace(F.regexp_replace(token, _OPENING, ""), _CLOSING, "")


def _period(core: Column) -> Column:
    """Whether one period ends it."""
    return core.endswith(".") & ~core.endswith("..")


def _type(core: Column) -> Column:
    return F.lower(F.when(_period(core), F.substring(core, F.lit(1), F.length(core) - 1)).otherwise(core))


def _upper(core: Column) -> Column:
    return core.rlike(r"^\p{Lu}")


def _tokens(text: Column) -> Column:
    return T.tokens(F.coalesce(text.cast("string"), F.lit("")))


class _Ends(dict):
    """For each token: 0, 1 if it may end a sentence, 2 if it surely does. It holds no line ends, so $ is its very end, as in Spark."""

    def __missing__(self, token: str) -> int:
        self[token] = kind = 2 if _SURE.search(token) else 1 if _MAYBE.search(token) else 0
        return kind


def _split(text: str) -> list[str]:
    """The tokens as T.tokens() has them; Python's own white space has four control characters more."""
    return [t for t in _SPACE.split(text) if t] if _CONTROL.search(text) else text.split()


def type_counts(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, n_with, n_without, n_lower, n_inside, n_starts) of the corpus's words.

    With and without a period; begun in lower case; begun in upper case behind
    a token that ends no sentence; the same as the first of a text or behind
    ! or ?, where no abbreviation can be. Numbers are no words. Equal tokens are
    counted in their task first; only distinct ones meet patterns and a shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, every, behind = _Ends(), Counter(), (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            found = [(t, n, True, False) for t, n in every.items()]
            found += [(t, n, False, starts) for starts in (False, True) for t, n in behind[starts].items()]
            for c in (every, *behind):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for text in batch.column(0):
                tokens = _split(text.as_py())
                if not tokens:
                    continue
                every.update(tokens)
                behind[True][tokens[0]] += 1
                every[tokens[0]] -= 1
                for i, kind in enumerate([ends[t] for t in tokens[:-1]], 1):
                    if kind:
                        behind[kind == 2][tokens[i]] += 1
                        every[tokens[i]] -= 1
                if len(every) > DISTINCT_TOKENS:
                    yield rows()
            if len(ends) > DISTINCT_TOKENS:
                ends.clear()
        if every:
            yield rows()

    schema = pa.schema([("token", pa.string()), ("n", pa.int64()), ("inside", pa.bool_()), ("starts", pa.bool_())])
    tokens = corpus.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(counted, "token string, n bigint, inside boolean, starts boolean")

    def described(core: Column) -> Column:
        word = core.rlike(_WORD) & ~core.endswith("..")
        return F.struct(_type(core).alias("type"), _period(core).alias("period"), core.rlike(r"^\p{Ll}").alias("lower"), _upper(core).alias("upper"), word.alias("word"))

    # Exploded, so that each token's patterns are tried once and not again in every filter and sum.
    rows = tokens.where("n > 0").select("n", "inside", "starts", F.explode(F.transform(F.array(_core(F.col("token"))), described)).alias("d")).select("*", "d.*").where("word")
    of = lambda which: F.sum(F.when(which, F.col("n")).otherwise(F.lit(0).cast("long")))
    return rows.groupBy("type").agg(
        of(F.col("period")).alias("n_with"), of(~F.col("period")).alias("n_without"),
        of(F.col("lower")).alias("n_lower"), of(F.col("upper") & F.col("inside")).alias("n_inside"), of(F.col("upper") & F.col("starts")).alias("n_starts"),
    )


def _log_likelihood(hits: Column, misses: Column, p: Column) -> Column:
    return hits * F.log(p) + F.when(misses > 0, misses * F.log(1 - p)).otherwise(0.0)


def scored_types(counts: DataFrame) -> DataFrame:
    """Types that a period follows somewhere, with their score as abbreviations."""
    p = counts.agg((F.sum("n_with") / F.sum(F.col("n_with") + F.col("n_without"))).alias("p")).scalar()
    hits, misses = F.col("n_with"), F.col("n_without")
    ratio = 2 * (_log_likelihood(hits, misses, F.lit(ABBREVIATED)) - _log_likelihood(hits, misses, p))
    inner = F.length("type") - F.length(F.replace("type", F.lit(".")))
    letters = F.length("type") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -misses)
    return counts.where("n_with > 0").withColumn("score", score)


def abbreviations(counts: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(type, n_with, n_without, score) of the abbreviations among type_counts()."""
    return scored_types(counts).where(F.col("score") >= least).select("type", "n_with", "n_without", "score")


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def guarded_sentences(texts: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(id, sentences) of each text: its tokens joined by spaces, ended by . ! ? and what closes behind them.

    `counts` are the type_counts() of a corpus, which may be the texts
    themselves. A period behind an abbreviation ends a sentence only before a
    starter, one behind a number not before lower case. What follows the last
    end is a sentence too. Null texts and those without tokens have none. Ids
    must be unique and not null.
    """
    known = abbreviations(counts, least).select(F.col("type").alias("short"))
    starters = counts.where("n_lower > 0 AND n_inside = 0 AND n_starts > 0").select(F.col("type").alias("begins"), F.lit(True).alias("starter"))

    def candidates(own: Column) -> Column:
        def one(i: Column) -> Column:
            here, then = _core(F.get(own, i)), _core(F.get(own, i + 1))
            return F.struct(i.alias("pos"), _type(here).alias("short"), F.when(_upper(then), _type(then)).alias("begins"))

        def short(token: Column) -> Column:
            # Most tokens have no period, which is told without a pattern.
            return F.contains(token, F.lit(".")) & _period(_core(token)) & _core(token).rlike(_WORD)

        return F.transform(F.filter(T.places(0, F.size(own) - 1), lambda i: short(F.get(own, i))), one)

    rows = texts.select(id_col, F.explode(T.bind(_tokens(F.col(text_col)), candidates)).alias("c")).select(id_col, "c.*")
    held = rows.join(_sent(known), "short").join(_sent(starters), "begins", "left").where("starter IS NULL")
    inside = held.groupBy(id_col).agg(F.collect_set("pos").alias("__inside"))

    def cut(own: Column, inside: Column) -> Column:
        n = F.size(own)

        def ends(i: Column) -> Column:
            core, then = _core(F.get(own, i)), F.get(own, i + 1)
            ordinal = core.rlike(_NUMBER) & then.rlike(r"^\p{Ll}")
            return (i == n - 1) | (F.get(own, i).rlike(_END) & ~ordinal & ~F.array_contains(inside, i))

        last = F.filter(T.places(0, n), ends)
        return T.bind(last, lambda at: F.transform(at, lambda e, k: F.array_join(F.slice(own, F.when(k > 0, F.get(at, k - 1) + 2).otherwise(1), e - F.when(k > 0, F.get(at, k - 1)).otherwise(-1)), " ")))

    none = F.array().cast("array<int>")
    joined = texts.select(id_col, text_col).join(inside, id_col, "left").withColumn("__inside", F.coalesce("__inside", none))
    return joined.select(id_col, T.bind(_tokens(F.col(text_col)), lambda own: cut(own, F.col("__inside"))).alias("sentences"))
