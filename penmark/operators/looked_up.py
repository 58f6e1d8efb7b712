"""Values of a table of words, told to texts by packed blocks: no word of a text is a row of a shuffle.

Texts are dealt out in blocks by their ids, words in shards by their CRC. A block
asks each shard once for its distinct words of that shard, in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from penmark.operators.own_counts import BLOCK_BYTES, text_bytes

#: `use` of looked_up(): the text of each word, the distinct words' places, and their values (NaN for words that the table has not); how many texts there are.
Use = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def _coded(table: pa.Table, shards: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in the order of their shards, where each shard's begin, and the text and the word of each place."""
    lists = table["words"].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().cast(pa.binary()).dictionary_encode()
    shard = np.fromiter((crc32(w) % shards for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    # Within a shard in the order of the alphabet, so that both steps see one order.
    order = np.lexsort((pc.rank(coded.dictionary, tiebreaker="first").to_numpy(), shard))
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    words = place[coded.indices.to_numpy(zero_copy_only=False)]
    return coded.dictionary.take(pa.array(order)), np.searchsorted(shard[order], np.arange(shards + 1)), np.repeat(np.arange(lengths.size), lengths), words


def looked_up(units: DataFrame, words: Callable[[Column], Column], table: DataFrame, value: str, use: Use, *, id_col: str = "doc_id", text_col: str = "text", n_bytes: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, value) of every row: what `use` makes of the values of its words in `table` (word, `value`), whose words are distinct.

    Rows of one id are one text. `n_bytes`, the texts' size, is summed up if not
    given. Ids are told by two 64-bit hashes.
    """
    kind = units.schema[id_col].dataType
    size = text_bytes(units, text_col) if n_bytes is None else n_bytes
    blocks = max(units.sparkSession.sparkContext.defaultParallelism, ceil(size / block_bytes))
    dealt = units.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")
    # Both steps that read the texts take the same columns, so that they are shuffled once.
    rows = dealt.select("block", "id", F.xxhash64("id").alias("one"), F.xxhash64(F.lit(1), "id").alias("two"), words(F.col("text")).alias("words"))
    entries = table.select(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(blocks)).cast("int").alias("shard"), "word", F.col(value).cast("double").alias("value"))

    def asked(table: pa.Table) -> pa.Table:
        names, at, _, _ = _coded(table, blocks)
        all_ = names.to_pylist()
        joined = [b"\n".join(all_[a:b]) for a, b in zip(at, at[1:], strict=False)]
        return pa.table({"block": pa.array([table["block"][0].as_py()] * blocks, pa.int32()), "shard": pa.array(range(blocks), pa.int32()), "names": pa.array(joined, pa.binary())})

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(left["word"].cast(pa.binary()).to_pylist(), left["value"].to_pylist(), strict=True)) if right.num_rows else {}
        told = []
        for names in right["names"]:
            found = [known.get(w) for w in names.as_py().split(b"\n")] if names.as_py() else []
            told.append(np.array(found, np.float64).tobytes())
        return pa.table({"block": right["block"], "shard": right["shard"], "told": pa.array(told, pa.binary())})

    def used(left: pa.Table, right: pa.Table) -> pa.Table:
        names, _, text, word = _coded(left, blocks)
        ordered = right.take(pc.sort_indices(right["shard"]))
        values = np.concatenate([np.frombuffer(t.as_buffer()) for t in ordered["told"]])
        ids = np.column_stack([left["one"].to_numpy(), left["two"].to_numpy()])
        _, own = np.unique(ids, axis=0, return_inverse=True) if np.unique(ids[:, 0]).size < len(ids) else (None, np.arange(len(ids)))
        own = own.ravel()
        made = use(own[text], word, values, int(own.max()) + 1)
        return pa.table({"id": left["id"], value: pa.array(made[own], pa.float64())})

    questions = rows.groupBy("block").applyInArrow(asked, "block int, shard int, names binary")
    answers = entries.groupBy("shard").cogroup(questions.groupBy("shard")).applyInArrow(answered, "block int, shard int, told binary")
    found = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(used, StructType([StructField("id", kind), StructField(value, DoubleType())]))
    return found.withColumnRenamed("id", id_col)
