"""Periodic runs of words, found in suffix trees of the texts, and texts with the repetitions taken out.

A text's runs need its own words only, so nothing is shuffled: tasks build the
suffix trees of some megabytes of texts together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions.text import bind
from penmark.llm.memory import give_back
from penmark.llm.session import table
from penmark.llm.suffix_tree import maximal_runs
from penmark.llm.textbytes import NOT_SPACE, Words, pieces, string_buffer

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Bytes of texts whose suffix trees are built together.
PIECE_BYTES = 2_000_000
WORD = r"[^\x20\x09-\x0D]+"


def _collapsed(raw: np.ndarray, offsets: np.ndarray, words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    last = np.zeros(kept.size, dtype=bool)
    texts = words.text[kept]
    last[np.flatnonzero(kept)[np.flatnonzero(np.diff(texts, append=-1))]] = True
    joined = raw.copy()
    gaps = words.end[kept & ~last]
    joined[gaps] = 32
    edge = np.zeros(raw.size + 1, dtype=np.int8)
    edge[words.start[kept]] = 1
    edge[words.end[kept]] -= 1
    stays = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    stays[gaps] = True
    ends = np.concatenate([[0], np.cumsum(stays, dtype=np.int64)])[offsets].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(joined[stays])])


def _runs_of_texts(raw: np.ndarray, offsets: np.ndarray, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text of a piece."""
    words, n = Words(raw, offsets, NOT_SPACE, lower=False), len(offsets) - 1
    distinct, symbols = np.unique(words.hash, return_inverse=True)
    ends = words.first[1:] + np.arange(n)  # a symbol of its own ends each text
    place = np.arange(symbols.size) + words.text
    sequence = np.empty(symbols.size + n, dtype=np.int64)
    sequence[place] = words.text * (distinct.size + 1) + symbols
    sequence[ends] = np.arange(n) * (distinct.size + 1) + distinct.size
    start, end, period = maximal_runs(sequence, min_exponent)
    long = end - start >= min_length
    start, end, period = start[long], end[long], period[long]
    text = np.searchsorted(ends, start)
    repeated = np.zeros(sequence.size + 1, dtype=np.int64)
    np.add.at(repeated, start + period, 1)
    np.add.at(repeated, end, -1)
    kept = np.cumsum(repeated)[place] == 0
    numbers = [start - words.first[text] - text, end - start, period]
    values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in numbers], names=["start", "length", "period"])
    bounds = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, values), _collapsed(raw, offsets, words, kept)


def periodic_runs(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """The maximal periodic runs of each text's words, and the text without what they repeat.

    Words are what stands between spaces, tabs and line ends, numbered from 0.
    A run is a stretch with a smallest period q (words q apart are equal) of at
    least `min_length` words and `min_exponent` (2 or more) periods, which no
    neighbouring word extends. Returns a row for each row of `documents`:
    id_col, runs (array of start, length, period; by start, then period) and
    collapsed_text, in which each run has its first q words only and all words
    are joined by one space. Runs may overlap; a word goes if
    any run says so. A null or empty text, or one of white space, has no words,
    no runs and an empty collapsed text. Repeated rows and null ids are treated
    like all others; further columns are not read. A task holds about
    PIECE_BYTES of texts, or one text, at a time. Words are told by 64-bit
    hashes within a text.
    """
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffer(batch.column(1))
            for a, b in pieces(offsets, PIECE_BYTES):
                low, high = offsets[a], offsets[b]
                runs, texts = _runs_of_texts(raw[low:high], offsets[a : b + 1] - low, min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), runs, texts], names=["id", "runs", "collapsed_text"])
        give_back()

    rows = source.mapInArrow(found, f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string")
    return rows.withColumnRenamed("id", id_col)


def with_planted_period(text: Column, key: Column) -> Column:
    """A tenth of all texts, chosen by their key, made periodic from some word on; others as they are.

    With h = crc32 of the key in decimal, g = h div 10 and n words: where h is
    divisible by 10 and n > 0, each word i >= a becomes word a + (i - a) % p,
    for a = g % n and p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(WORD), 0)

    def rebuilt(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")

    chosen = (h % 10 == 0) & text.rlike(WORD)
    return F.when(chosen, bind(words, rebuilt)).otherwise(text)


def op11_periodic_run_detection(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("often"))))
    found = periodic_runs(documents).withColumn("best", best)
    length, start, period = F.col("best.length"), -F.col("best.before"), -F.col("best.often")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


#: crc32 bit by bit, then all pairs of equal words a period apart, whose unbroken stretches are the runs.
OP11_SQL = r"""
WITH hashed AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
      lambda i: [ascii((doc_id::VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h
  FROM documents),
parts AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS times FROM hashed),
words AS (
  SELECT r, n, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // times) END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM parts)),
pairs AS (
  SELECT x.r, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.r, y.i - x.i ORDER BY x.i) AS stretch
  FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM pairs GROUP BY r, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
reports AS (
  SELECT r, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'p': period}, row(length, -start, -period)) AS best,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM parts LEFT JOIN reports USING (r) LEFT JOIN kept USING (r)
"""
