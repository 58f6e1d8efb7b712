"""How often words and adjacent words occur in a corpus, told to the very texts that were counted.

Texts are dealt out in blocks by their ids. A block lists each of its distinct
words and pairs once, as 64-bit hashes with its counts, in one packed row for
each shard of the hashes; a shard adds up the counts of all blocks and sends
each block the totals of what it listed. So no row of a single word is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, on average.
BLOCK_BYTES = 8_000_000

#: `use` of own_counts(): sequence lengths, totals of words, totals of pairs (groups x words), sums of words, sums of pairs.
Use = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def text_bytes(units: DataFrame, text_col: str = "text") -> int:
    return units.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _sequences(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Flat hashes and the length of each sequence of a column of lists, or of lists of lists; and the lists."""
    lists = column.combine_chunks()
    inner = lists.flatten() if pa.types.is_list(lists.type.value_type) else lists
    return inner.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False), lists


def _keys(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words (even) followed by those of pairs (odd), and the places of the pairs' first words."""
    inside = np.ones(flat.size, dtype=bool)
    ends = np.cumsum(lengths)
    inside[ends[lengths > 0] - 1] = False
    first = np.flatnonzero(inside)
    mixed = flat[first] * np.uint64(0x9E3779B97F4A7C15) + flat[first + 1] if first.size else flat[:0]
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate([flat & ~np.uint64(1), (mixed ^ mixed >> np.uint64(29)) | np.uint64(1)]), first


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard of sorted keys begins, and the end."""
    if not bits:
        return np.array([0, keys.size])
    steps = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, steps), keys.size)


def own_counts(
    units: DataFrame, own: Callable[[Column], Column], use: Use, values: tuple[str, ...], *, id_col: str = "doc_id", text_col: str = "text",
    asked: Callable[[Column], Column] | None = None, times: tuple[str, ...] = (), n_bytes: int | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, text, *values) of every text: what `use` makes of the counts of its words and pairs in all `units`.

    `own` gives a text's words. The columns `times` say how often they count in
    each group, null for not at all; without them each counts once in the only
    group. `n_bytes`, the texts' size, is summed up if not given. `asked` gives lists of words whose
    counts are wanted, the words themselves without it. Each value is an array
    of doubles, one for each word, or an array of these. A pair's totals stand
    with its first word, zeros with the last. Sums are the number of distinct
    counted keys, then the sum of each group's counts. Ids must be unique.
    """
    kind, text_kind = units.schema[id_col].dataType, units.schema[text_col].dataType
    size = text_bytes(units, text_col) if n_bytes is None else n_bytes
    blocks = max(units.sparkSession.sparkContext.defaultParallelism, ceil(size / block_bytes))
    bits = (blocks - 1).bit_length()
    groups = max(1, len(times))
    counted = F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in times]) if times else F.array(F.lit(1))
    dealt = units.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), counted.alias("times"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")
    columns = [hashes(own(F.col("text"))).alias("own")]
    if asked is not None:
        columns.append(F.transform(asked(F.col("text")), hashes).alias("asked"))
    rows = dealt.select("block", "times", *columns)

    def listed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple | None]:
        """Sorted keys of a block, the place of each key of its sequences among them, counts by group, and what is asked."""
        flat, lengths, lists = _sequences(table["own"])
        keys, first = _keys(flat, lengths)
        weights = np.repeat(table["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, groups), lengths, axis=0).astype(np.float64)
        weights = np.concatenate([weights, weights[first]])
        wanted = (flat, lengths, lists, first)
        n = keys.size
        if asked is not None:
            flat, lengths, lists = _sequences(table["asked"])
            more, first = _keys(flat, lengths)
            keys, wanted = np.concatenate([keys, more]), (flat, lengths, lists, first)
        distinct, place = np.unique(keys, return_inverse=True)
        counts = np.array([np.bincount(place[:n], weights=weights[:, k], minlength=distinct.size) for k in range(groups)]).astype(np.uint32)
        return distinct, place if asked is None else place[n:], counts, wanted

    def list_block(table: pa.Table) -> pa.Table:
        distinct, _, counts, _ = listed(table)
        at = _bounds(distinct, bits)
        parts = list(zip(at, at[1:], strict=False))
        return pa.table({
            "block": pa.array([table["block"][0].as_py()] * len(parts), pa.int32()), "shard": pa.array(range(len(parts)), pa.int32()),
            "keys": pa.array([distinct[a:b].tobytes() for a, b in parts], pa.binary()), "counts": pa.array([counts[:, a:b].tobytes() for a, b in parts], pa.binary()),
        })

    def add_up(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k.as_buffer(), np.uint64) for k in table["keys"]]
        counts = np.concatenate([np.frombuffer(c.as_buffer(), np.uint32).reshape(groups, -1) for c in table["counts"]], axis=1)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.array([np.bincount(place, weights=c, minlength=distinct.size) for c in counts]).astype(np.uint64)
        pair, seen = distinct & np.uint64(1) == 1, totals.sum(axis=0) > 0
        sums = np.concatenate([[np.count_nonzero(m & seen), *totals[:, m].sum(axis=1)] for m in (~pair, pair)]).astype(np.int64)
        whole = totals if not totals.size or totals.max() > 0xFFFFFFFF else totals.astype(np.uint32)
        ends = np.cumsum([0] + [k.size for k in keys])
        sent = [whole[:, place[a:b]].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"block": table["block"], "shard": table["shard"], "totals": pa.array(sent, pa.binary()), "sums": pa.array([sums.tolist()] * len(keys), pa.list_(pa.int64()))})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        distinct, place, _, (flat, lengths, lists, first) = listed(left)
        order = np.argsort(right["shard"].to_numpy())
        at = _bounds(distinct, bits)
        totals = np.zeros((groups, distinct.size))
        sums = np.zeros(2 + 2 * groups)
        for i in order:
            shard, packed = right["shard"][i].as_py(), right["totals"][i].as_buffer()
            n = at[shard + 1] - at[shard]
            if n:
                totals[:, at[shard] : at[shard + 1]] = np.frombuffer(packed, np.uint32 if packed.size == 4 * n * groups else np.uint64).reshape(groups, n)
            sums += np.array(right["sums"][i].as_py())
        words, pairs = totals[:, place[: flat.size]], np.zeros((groups, flat.size))
        pairs[:, first] = totals[:, place[flat.size :]]
        made = use(lengths, words, pairs, sums[: 1 + groups], sums[1 + groups :])

        def shaped(flat_values: np.ndarray) -> pa.Array:
            inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat_values, pa.float64()))
            if asked is None:
                return inner
            outer = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(outer)), pa.int32()), inner)

        return pa.table({"id": left["id"], "text": left["text"], **{v: shaped(m) for v, m in zip(values, made, strict=True)}})

    listing = rows.groupBy("block").applyInArrow(list_block, "block int, shard int, keys binary, counts binary")
    totals = listing.groupBy("shard").applyInArrow(add_up, "block int, shard int, totals binary, sums array<bigint>")
    many = "array<double>" if asked is None else "array<array<double>>"
    schema = f"id {kind.simpleString()}, text {text_kind.simpleString()}, " + ", ".join(f"{v} {many}" for v in values)
    full = dealt.select("id", "text", "block", "times", *columns)
    answered = full.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(answer, schema)
    return answered.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *values)
