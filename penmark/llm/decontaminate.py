"""Benchmark decontamination by an FM-index of each training shard.

Every task cuts its documents into shards of a few megabytes, indexes the words
of a shard (suffix array, Burrows-Wheeler symbols, wavelet matrix, sampled
suffix positions) and searches all benchmark windows backwards at once. Nothing
of the documents is shuffled. The windows are the stated query set: they are
sent to the tasks in blocks of at most `block_rows` rows; a benchmark beyond
one block costs one more pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.fm_index import FMIndex
from penmark.llm.session import checkpointed, table
from penmark.llm.textbytes import ALPHANUMERIC, Words, pieces, string_buffer

WINDOW = 10
SHARD_BYTES = 3_000_000
BLOCK_ROWS = 250_000


def windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (phrase, item): the 64-bit word hashes of each window, as bytes; a shorter item is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffer(batch.column(1))
            words = Words(raw, offsets, ALPHANUMERIC)
            items = batch.column(0).to_pylist()
            phrases, owners = [], []
            for i, item in enumerate(items):
                own = words.hash[words.first[i] : words.first[i + 1]]
                for start in range(max(1, own.size - window + 1) if own.size else 0):
                    phrases.append(own[start : start + window].tobytes())
                    owners.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(owners, pa.string())], names=["phrase", "item"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    return items.mapInArrow(cut, "phrase binary, item string").distinct()


class _Phrases:
    """A block of phrases as right-aligned word hashes, and the items of each phrase."""

    def __init__(self, rows: pa.Table, window: int):
        phrase, item = rows.column("phrase").to_pylist(), rows.column("item").to_pylist()
        self.items = sorted(set(item))
        number = {x: i for i, x in enumerate(self.items)}
        owners: dict[bytes, list[int]] = {}
        for p, x in zip(phrase, item, strict=True):
            owners.setdefault(p, []).append(number[x])
        self.hashes = np.zeros((len(owners), window), dtype=np.uint64)
        self.length = np.zeros(len(owners), dtype=np.int64)
        for i, p in enumerate(owners):
            words = np.frombuffer(p, dtype=np.uint64)
            self.hashes[i, window - words.size :] = words
            self.length[i] = words.size
        self.owner = np.array([x for own in owners.values() for x in own], dtype=np.int64)
        self.owner_first = np.concatenate([[0], np.cumsum([len(own) for own in owners.values()], dtype=np.int64)])
        self.used = np.arange(window)[None, :] >= window - self.length[:, None]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of count[i] numbers, for all i in turn."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


def _occurrences(words: Words, phrases: _Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and first word (counted over the shard) of each occurrence of a phrase within one text."""
    texts = len(words.counts)
    vocabulary, symbol = np.unique(words.hash, return_inverse=True)
    known = np.zeros((0, phrases.hashes.shape[1]), dtype=np.int64)
    able = np.zeros(0, dtype=np.int64)
    if vocabulary.size:
        place = np.minimum(np.searchsorted(vocabulary, phrases.hashes), vocabulary.size - 1)
        able = np.flatnonzero(((vocabulary[place] == phrases.hashes) | ~phrases.used).all(axis=1))
        known = np.where(phrases.used, place + texts + 1, -1)[able]
    if not able.size:
        return able, able
    # Each text ends in a symbol of its own, so that no match crosses it.
    symbols = np.zeros(words.hash.size + texts, dtype=np.int64)
    symbols[np.arange(words.hash.size) + words.text] = symbol + texts + 1
    ends = words.first[1:] + np.arange(texts)
    symbols[ends] = np.arange(1, texts + 1)
    index = FMIndex(symbols)
    low, high = index.search(known)
    position = index.locate(_ranges(low, high - low))
    return np.repeat(able, high - low), position - np.searchsorted(ends, position)


def _judge_shard(raw: np.ndarray, offsets: np.ndarray, phrases: _Phrases, earlier: tuple[pa.Array, pa.Array] | None) -> list[pa.Array]:
    """Columns n_words, n_hit, items, spans of a shard; `earlier`: items and spans of the blocks before."""
    texts = len(offsets) - 1
    words = Words(raw, offsets, ALPHANUMERIC)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    phrase, word = _occurrences(words, phrases)
    cover = np.zeros(words.hash.size + 1, dtype=np.int64)
    np.add.at(cover, word, 1)
    np.subtract.at(cover, word + phrases.length[phrase], 1)
    if earlier:
        spans = earlier[1].flatten()
        base = points[offsets[earlier[1].value_parent_indices().to_numpy()]]
        np.add.at(cover, np.searchsorted(points[words.start], base + spans.field("start").to_numpy()), 1)
        np.subtract.at(cover, np.searchsorted(points[words.start], base + spans.field("end").to_numpy()), 1)
    hit = np.cumsum(cover)[:-1] > 0
    n_hit = np.bincount(words.text[hit], minlength=texts)

    pair = np.unique(words.text[word] * (len(phrases.length) + 1) + phrase)
    text_of, phrase = np.divmod(pair, len(phrases.length) + 1)
    count = phrases.owner_first[phrase + 1] - phrases.owner_first[phrase]
    owner = phrases.owner[_ranges(phrases.owner_first[phrase], count)]
    pair = np.unique(np.repeat(text_of, count) * (len(phrases.items) + 1) + owner)
    text_of, owner = np.divmod(pair, len(phrases.items) + 1)
    names = pa.array(phrases.items, pa.string()).take(pa.array(owner))
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(text_of, np.arange(texts + 1)), pa.int32()), names)
    if earlier:
        items = pa.array([sorted({*x, *y}) for x, y in zip(earlier[0].to_pylist(), items.to_pylist(), strict=True)], pa.list_(pa.string()))

    at = np.flatnonzero(hit)
    joined = np.zeros(at.size, dtype=bool)
    joined[1:] = (at[1:] == at[:-1] + 1) & (words.text[at[1:]] == words.text[at[:-1]])
    span_first = at[~joined]
    last = np.ones(at.size, dtype=bool)
    last[:-1] = ~joined[1:]
    span_text, start, end = words.text[span_first], words.start[span_first], words.end[at[last]]
    base = points[offsets[span_text]]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(span_text, np.arange(texts + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(points[start] - base, pa.int32()), pa.array(points[end] - base, pa.int32())], names=["start", "end"]),
    )
    return [pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), items, spans]


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_rows: int = BLOCK_ROWS,
    shard_bytes: int = SHARD_BYTES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Where the benchmark's windows of `window` words occur in each document.

    Returns a row for each row of `documents`: id_col, the columns of `carry`,
    n_words and n_hit (long),
    items (sorted item ids as strings) and spans (code points, end exclusive,
    merged). Words are runs of digits, a-z after lower-casing A-Z and non-ASCII
    characters. A null or empty text has no words; an item with a null id or no
    words has no window; an item of fewer words than a window is one window.
    Repeated rows are judged each for itself, repeated items by their ids. Other
    columns of either table are not read. Empty tables are fine on either side.
    """
    spark = documents.sparkSession
    asked = checkpointed(windows(benchmark, item_col, item_text_col, window))
    blocks = max(1, -(-asked.count() // block_rows))
    others = [c for c in carry if c != text_col]
    source = documents.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(others)]
    )
    names = [*source.columns, "n_words", "n_hit", "items", "spans"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)
    schema = f"{fields}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"

    def searched(found: DataFrame, block: int) -> DataFrame:
        rows = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(_Phrases(rows.toArrow(), window))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            for batch in batches:
                raw, offsets = string_buffer(batch.column(1))
                for low, high in pieces(offsets, shard_bytes):
                    own, part = batch.slice(low, high - low), offsets[low : high + 1]
                    earlier = (own.column("items"), own.column("spans")) if block else None
                    judged = _judge_shard(raw[part[0] : part[-1]], part - part[0], phrases, earlier)
                    yield pa.RecordBatch.from_arrays([*own.columns[: len(names) - 4], *judged], names=names)

        return found.mapInArrow(scan, schema)

    found = searched(source, 0)
    for block in range(1, blocks):
        found = searched(checkpointed(found), block)
    kept = [F.col("text" if c == text_col else f"carried_{others.index(c)}").alias(c) for c in carry]
    kept.insert(0, F.col("id").alias(id_col))
    return found.select(*kept, "n_words", "n_hit", "items", "spans")


def cut_spans(text: F.Column, spans: F.Column) -> F.Column:
    """`text` without the spans, which are sorted and disjoint."""
    kept = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda done, span: F.struct(
            F.concat(done["out"], F.substring(text, done["at"] + 1, span["start"] - done["at"])).alias("out"), span["end"].alias("at")
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(kept["out"], F.substring(text, kept["at"] + 1, F.length(text))))


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i + 1, i + least(10, len(w))), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, lengths)),
hits AS (SELECT doc_id, i, places.n, item_id FROM places JOIN windows ON places.n = windows.n AND places.phrase = windows.phrase),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""
