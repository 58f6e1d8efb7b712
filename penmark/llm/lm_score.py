"""Language-model scores of texts: context-tree weighting, beside a word-unigram base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm import ctw
from penmark.llm.blocks import placed
from penmark.llm.memory import give_back
from penmark.llm.session import checkpointed, remainder, table, total_bytes
from penmark.llm.textbytes import NOT_SPACE, Words, mix

#: Texts are counted and scored in pieces of this size.
PIECE_BYTES = 2_000_000
BLOCK_BYTES = 16_000_000
#: A task's counts are merged after so many new ones.
MERGED_CELLS = 4_000_000
#: Hash of the token that ends each text; no word hashes to it but by chance.
END = np.int64(0)


class _Tally:
    """Counts by key, merged whenever MERGED_CELLS new ones are there."""

    def __init__(self) -> None:
        self.keys, self.counts, self.new = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(n)
        self.new += key.size
        if self.new > MERGED_CELLS:
            self.merged()

    def add_all(self, keys: np.ndarray, counted: bool) -> None:
        """Counts each key once if `counted`, else as seen only."""
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, np.int64)
        n = np.diff(np.append(first, keys.size)) if counted else np.zeros(first.size, dtype=np.int64)
        self.add(keys[first], n)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys in order, and the sum of each."""
        key, n = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts = [], []
        key, n = ctw.summed_cells(key, n)
        self.keys, self.counts, self.new = [key], [n], 0
        return key, n


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=kind)


def _packed_keys(key: np.ndarray) -> bytes:
    """Keys in order, as their differences."""
    return _packed(np.diff(key, prepend=np.int64(0)))


def _unpacked_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(packed, np.int64))


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of `wanted` (ascending, so that the search stays within the cache), and the values in that order."""
    order = np.argsort(wanted)
    return order, values[np.searchsorted(keys, wanted[order])]


def lm_scores(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_out_fold: int = 2,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Scores every text by models of the training texts (crc32 of the id modulo `folds` is not `held_out_fold`).

    Returns for each row: id_col, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probability of the lower-cased text and its end
    under context-tree weighting) and bits_per_byte (its code length by byte,
    the end counting as one). A null text is empty: it has only its end. A row
    with a null id is scored, never learnt from, and not held out. Repeated rows
    count each for itself. Without training rows both models are uniform.
    Other columns are not read.

    The tree has every context of the training texts. Each block of texts lists
    its distinct cells (a byte below its context) by shard of the context's last
    bytes; a shard sums them over all blocks, and after the short contexts were
    put together it returns the log probability of each cell to its blocks.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    training = source.where(F.col("id").isNotNull() & (remainder("id", folds) != held_out_fold))
    shards = max(1, -(-total_bytes(training, "text") // block_bytes))

    texts = placed(source, "id", "text", block_bytes)
    texts = texts.withColumn("fold", remainder("id", folds)).select("block", "id", "fold", "text")
    kind = texts.schema["id"].dataType.simpleString()

    def opened(rows: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First and last row, bytes and offsets of some megabytes of a block's texts at a time."""
        expand = zstandard.ZstdDecompressor()
        own, size, low = [], 0, 0
        for i, packed in enumerate(rows.column("text")):
            own.append(expand.decompress(packed.as_py()))
            size += len(own[-1])
            if size > PIECE_BYTES or i + 1 == rows.num_rows:
                yield low, i + 1, np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])
                own, size, low = [], 0, i + 1

    def block_counts(rows: pa.Table) -> pa.Table:
        fold = rows.column("fold").to_numpy()
        learnt = (fold >= 0) & (fold != held_out_fold)
        words, cells = _Tally(), _Tally()
        words.add(np.array([END]), np.array([learnt.sum()]))
        for low, high, raw, offsets in opened(rows):
            found, own = Words(raw, offsets, NOT_SPACE), learnt[low:high]
            of_word, of_cell = own[found.text], np.repeat(own, np.diff(offsets) + 1)
            word, cell = found.hash.view(np.int64), ctw.cells(raw, offsets)
            del found
            for counted in (True, False):
                words.add_all(word[of_word == counted], counted)
                cells.add_all(cell[of_cell == counted], counted)
        parts = []
        for is_word, tally in ((True, words), (False, cells)):
            key, times = tally.merged()
            last = key if is_word else key >> ctw.BITS & ((1 << ctw.BITS * (ctw.UPPER + 1)) - 1)
            shard = (mix(last.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            shard, first = np.unique(shard[order], return_index=True)
            for k, keys, n in zip(shard, np.split(key[order], first[1:]), np.split(times[order], first[1:]), strict=True):
                parts.append((is_word, k, _packed_keys(keys), _packed(n)))
        del words, cells, key, times, last, order
        give_back()
        block = np.full(len(parts), rows.column("block")[0].as_py(), dtype=np.int32)
        columns = [pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.bool_(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
        return pa.table([pa.array(block), *columns], names=["block", "is_word", "shard", "keys", "times"])

    listed = checkpointed(texts.groupBy("block").applyInArrow(block_counts, "block int, is_word boolean, shard int, keys binary, times binary"))
    by_shard = listed.groupBy("is_word", "shard")

    def gathered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a shard and their counts over all blocks."""
        tally = _Tally()
        for keys, times in zip(rows.column("keys"), rows.column("times"), strict=True):
            tally.add(_unpacked_keys(keys.as_py()), _unpacked(times.as_py(), np.int64))
        return tally.merged()

    def summed(rows: pa.Table) -> pa.Table:
        key, times = gathered(rows)
        if rows.column("is_word")[0].as_py():
            return pa.table({"place": pa.nulls(1, pa.int64()), "n": [int(times.sum())], "log_below": [0.0], "distinct": [int(np.count_nonzero(times))]})
        place, n, log_below = ctw.Shard(key, times).summed()
        return pa.table({"place": place, "n": n, "log_below": log_below, "distinct": np.zeros(place.size, dtype=np.int64)})

    def upper_of(rows: pa.Table) -> pa.Table:
        total = rows.filter(pc.is_null(rows.column("place")))
        rows = rows.filter(pc.is_valid(rows.column("place")))
        counts, log_below = np.zeros(ctw.CODES ** (ctw.UPPER + 1), dtype=np.int64), np.zeros(ctw.CODES ** (ctw.UPPER + 1))
        place = rows.column("place").to_numpy()
        counts[place], log_below[place] = rows.column("n").to_numpy(), rows.column("log_below").to_numpy()
        upper = ctw.Upper(counts.reshape(-1, ctw.CODES), log_below.reshape(-1, ctw.CODES))
        return pa.table({
            "tokens": [total.column("n")[0].as_py()], "distinct": [total.column("distinct")[0].as_py()],
            **{name: pa.array([_packed(x)], pa.binary()) for name, x in (("settled", upper.settled), ("rest", upper.left), ("estimate", upper.estimate))},
        })

    # 256**(UPPER + 1) rows at most, whatever the input: one task, whose three tables go to all workers.
    short = by_shard.applyInArrow(summed, "place bigint, n bigint, log_below double, distinct bigint").groupBy("place")
    short = short.agg(*(F.sum(c).alias(c) for c in ("n", "log_below", "distinct"))).withColumn("tree", F.lit(0))
    top = short.groupBy("tree").applyInArrow(upper_of, "tokens bigint, distinct bigint, settled binary, rest binary, estimate binary").first()
    n_train, distinct = (top["tokens"], top["distinct"]) if top else (0, 0)
    upper = spark.sparkContext.broadcast([bytes(top[c]) for c in ("settled", "rest", "estimate")] if top else [])

    def returned(rows: pa.Table) -> pa.Table:
        key, times = gathered(rows)
        if rows.column("is_word")[0].as_py():
            value, kind = times, np.int64
        else:
            value, kind = ctw.Shard(key, times).log2(ctw.Upper.of(*(_unpacked(x, np.float64) for x in upper.value))), np.float32
        value = value.astype(kind)
        packed = [_packed(value[np.searchsorted(key, _unpacked_keys(keys.as_py()))]) for keys in rows.column("keys")]
        out = pa.table({**{c: rows.column(c) for c in ("block", "is_word", "keys")}, "found": pa.array(packed, pa.binary())})
        del key, times, value, packed
        give_back()
        return out

    known = by_shard.applyInArrow(returned, "block int, is_word boolean, keys binary, found binary")

    def looked_up(known: pa.Table, is_word: bool, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a block in order, and what is known of each."""
        own = known.filter(pc.equal(known.column("is_word"), is_word))
        key = np.concatenate([_unpacked_keys(x.as_py()) for x in own.column("keys")])
        order = np.argsort(key)
        return key[order], np.concatenate([_unpacked(x.as_py(), kind) for x in own.column("found")])[order]

    schema = (
        f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    )

    def scored(rows: pa.Table, known: pa.Table) -> pa.Table:
        vocabulary, counts = looked_up(known, True, np.int64)
        cells, values = looked_up(known, False, np.float32)
        ends = counts[np.searchsorted(vocabulary, END)]
        out = {name: [] for name in ("n_tokens", "n_known", "base", "log2", "size")}
        for _, _, raw, offsets in opened(rows):
            n = len(offsets) - 1
            found = Words(raw, offsets, NOT_SPACE)
            order, c = _looked_up(vocabulary, counts, found.hash.view(np.int64))
            owner = found.text[order]
            out["n_tokens"].append(found.counts + 1)
            out["n_known"].append(np.bincount(owner[c > 0], minlength=n) + int(ends > 0))
            base = np.bincount(owner, weights=np.log10(c + 1), minlength=n) + np.log10(ends + 1)
            out["base"].append(base - (found.counts + 1) * np.log10(n_train + distinct + 1))
            del found
            order, log2 = _looked_up(cells, values, ctw.cells(raw, offsets))
            out["log2"].append(np.bincount(np.repeat(np.arange(n), np.diff(offsets) + 1)[order], weights=log2, minlength=n))
            out["size"].append(np.diff(offsets) + 1)
        joined = {name: np.concatenate(x) for name, x in out.items()}
        columns = [
            rows.column("id"), pa.array(rows.column("fold").to_numpy() == held_out_fold), joined["n_tokens"], joined["n_known"],
            np.full(rows.num_rows, n_train), joined["base"], joined["log2"] * np.log10(2), -joined["log2"] / joined["size"],
        ]
        del cells, values, order, log2
        give_back()
        return pa.table(columns, names=[f.split()[0] for f in schema.split(", ")])

    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(scored, schema).withColumnRenamed("id", id_col)


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
