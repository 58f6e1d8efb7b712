"""Draws that perturb texts, by the bigram counts of those very texts, without a row of a word or a draw.

Texts are dealt out in blocks, words in shards. A block sends each shard, packed
in one row, its distinct words of that shard with what follows them; a shard adds
these up and returns the totals and the most frequent successors. With them the
block draws, asks each shard once for every distinct drawn word and the word
after it, and sums up what it is told. Words are told by their text, not by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from penmark.functions import text as T
from penmark.operators.own_counts import text_bytes

#: Bytes of text in a block, on average.
BLOCK_BYTES = 16_000_000
#: Words whose places are ordered at once, and pairs that a shard adds up at once.
STEP = 1 << 18
#: Hashes are cut to numbers below this.
NUMBERS = 1_000_000

_ONE, _TWO, _THREE, _FIVE = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_DRAW = np.array([int.from_bytes(b"draw", "little")], np.uint64)


def chained(seed: np.ndarray, value: np.ndarray) -> np.ndarray:
    """xxhash64 of columns that `seed` is the hash of and of one more, whose values take four bytes."""
    h = (seed + _FIVE + np.uint64(4)) ^ (value * _ONE)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * _TWO + _THREE
    h = (h ^ h >> np.uint64(33)) * _TWO
    h = (h ^ h >> np.uint64(29)) * _THREE
    return h ^ h >> np.uint64(32)


def _number(hashed: np.ndarray) -> np.ndarray:
    return np.mod(hashed.view(np.int64), NUMBERS)


def _packed(values: np.ndarray) -> bytes:
    """Counts as four planes of bytes, of which most are zeros that a shuffle compresses; as eight if one needs them."""
    wide = values.size and values.max() > 0xFFFFFFFF
    return (b"\x08" if wide else b"\x04") + values.astype(np.uint64 if wide else np.uint32).view(np.uint8).reshape(values.size, -1).T.tobytes() if values.size else b""


def _counts(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    width = packed[0]
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64 if width == 8 else np.uint32).ravel().astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if ends.size else 0)


def _split(joined: bytes) -> list[bytes]:
    return joined.split(b"\n") if joined else []


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(schema, columns, strict=True)}, schema=schema)


def _shards(words: list[bytes], shards: int) -> np.ndarray:
    return np.fromiter((crc32(w) % shards for w in words), np.int64, len(words))


class _Block:
    """Words of a block, in the order of their shards and within these of the alphabet, and its distinct pairs of adjacent words."""

    def __init__(self, table: pa.Table, shards: int):
        lists = table["words"].combine_chunks()
        self.lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().cast(pa.binary()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        shard = _shards(names, shards)
        alphabet = np.empty(len(names), np.int64)
        alphabet[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(names))
        order = np.lexsort((alphabet, shard))
        place = np.empty(len(names), np.int32)
        place[order] = np.arange(len(names))
        self.names = [names[i] for i in order]
        self.flat = place[coded.indices.to_numpy(zero_copy_only=False)]
        self.at = np.searchsorted(shard[order], np.arange(shards + 1))
        inside = np.ones(self.flat.size, dtype=bool)
        inside[np.cumsum(self.lengths)[self.lengths > 0] - 1] = False
        self.first = np.flatnonzero(inside)
        keys = self.flat[self.first].astype(np.int64) * len(names) + self.flat[self.first + 1] if self.first.size else self.first
        distinct, pair, self.pair_counts = np.unique(keys, return_inverse=True, return_counts=True)
        self.pair = pair.astype(np.int32)
        self.before, self.second = distinct // max(1, len(names)), distinct % max(1, len(names))

    def table_of(self, words: np.ndarray) -> tuple[bytes, bytes]:
        """The distinct words, and the place of each among them."""
        distinct, place = np.unique(words, return_inverse=True)
        return b"\n".join([self.names[i] for i in distinct]), _packed(place)

    def listing(self) -> Iterator[tuple]:
        """For each shard: words, counts, numbers of successors, and what they are and how often."""
        occurring, fan = np.bincount(self.flat, minlength=len(self.names)), np.bincount(self.before, minlength=len(self.names))
        ends = np.append(0, np.cumsum(fan))
        for k, (a, b) in enumerate(zip(self.at, self.at[1:], strict=False)):
            pairs = slice(ends[a], ends[b])
            yield k, b"\n".join(self.names[a:b]), _packed(occurring[a:b]), _packed(fan[a:b]), *self.table_of(self.second[pairs]), _packed(self.pair_counts[pairs])


class _Shard:
    """Totals of the listings of a shard: counts of its words, and of its pairs by sorted keys."""

    def __init__(self, table: pa.Table):
        self.words: dict[bytes, int] = {}
        self.others: dict[bytes, int] = {}
        self.own, self.pairs = [], []
        self.keys, self.totals = np.zeros(0, np.int64), np.zeros(0, np.int64)
        pending, size = [], 0
        occurring = []
        for i in range(table.num_rows):
            words, counts, fan, others, second, times = (table[c][i].as_py() for c in ("words", "counts", "fan", "others", "second", "times"))
            own = self._known(self.words, _split(words))
            keys = np.repeat(own, _counts(fan)) << 32 | self._known(self.others, _split(others))[_counts(second)]
            self.own.append(own)
            self.pairs.append(keys)
            occurring.append(_counts(counts))
            pending.append((keys, _counts(times)))
            size += keys.size
            if size > STEP + self.keys.size:
                self._add(pending)
                pending, size = [], 0
        self._add(pending)
        self.counts = np.zeros(len(self.words), np.int64)
        for own, n in zip(self.own, occurring, strict=True):
            self.counts[own] += n

    @staticmethod
    def _known(all_: dict[bytes, int], words: list[bytes]) -> np.ndarray:
        return np.fromiter((all_.setdefault(w, len(all_)) for w in words), np.int64, len(words))

    def _add(self, pending: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in pending)])
        times = np.concatenate([self.totals, *(n for _, n in pending)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else order
        self.keys, self.totals = keys[starts], np.add.reduceat(times[order], starts) if keys.size else times

    def found(self, keys: np.ndarray) -> np.ndarray:
        """Totals of the keys of pairs, zero for those that don't occur."""
        if not self.keys.size:
            return np.zeros(keys.size, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        return np.where(self.keys[at] == keys, self.totals[at], 0)

    def best(self, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The `top` successors of each word by their totals, then in the order of the alphabet: where each word's begin, and the end; successors; totals."""
        names = list(self.others)
        alphabet = np.empty(len(names), np.int64)
        alphabet[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        word, second = self.keys >> 32, self.keys & 0xFFFFFFFF
        order = np.lexsort((alphabet[second], -self.totals, word))
        fan = np.bincount(word, minlength=len(self.words))
        kept = order[_ranges(np.cumsum(fan) - fan, np.minimum(fan, top))]
        return np.append(0, np.cumsum(np.minimum(fan, top))), second[kept], self.totals[kept]


def own_draws(units: DataFrame, id_col: str, text_col: str, *, replicas: int, share: float, top: int, seed: int, added: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, mean, change, std) of every text of three words or more: its mean surprisal, and mean and population deviation, over replicas, of the change of its mean log probability.

    What is drawn is told at lm.curvature().
    """
    kind = units.schema[id_col].dataType
    blocks = max(units.sparkSession.sparkContext.defaultParallelism, ceil(text_bytes(units, text_col) / block_bytes))
    shards = blocks
    dealt = units.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")
    # Both steps that read the texts take the same columns, so that they are shuffled once.
    rows = dealt.select("block", "id", F.xxhash64(F.lit(seed), "id").alias("hash"), T.words(F.col("text")).alias("words"))

    listing_schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("words", "counts", "fan", "others", "second", "times"))])
    totals_schema = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("distinct", pa.int64()), *((c, pa.binary()) for c in ("counts", "totals", "kept", "others", "second", "times"))])
    asked = ("words", "fan", "others", "second")
    state = ("place", "sizes", "means", "known")

    def listed(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        return _table([(k, block, *rest) for k, *rest in _Block(table, shards).listing()], listing_schema)

    def added_up(table: pa.Table) -> pa.Table:
        shard = _Shard(table)
        starts, second, times = shard.best(top)
        names = list(shard.others)
        out = []
        for i, (own, pairs) in enumerate(zip(shard.own, shard.pairs, strict=True)):
            kept = starts[own + 1] - starts[own]
            options = _ranges(starts[own], kept)
            distinct, place = np.unique(second[options], return_inverse=True)
            out.append((
                table["block"][i].as_py(), table["shard"][i].as_py(), len(shard.words), _packed(shard.counts[own]), _packed(shard.found(pairs)),
                _packed(kept), b"\n".join([names[j] for j in distinct]), _packed(place), _packed(times[options]),
            ))
        return _table(out, totals_schema)

    def many(pairs: np.ndarray) -> np.ndarray:
        return np.minimum(pairs - 1, np.maximum(1, np.floor(pairs * share))).astype(np.int64)

    def made(block: _Block, hashed: np.ndarray, right: pa.Table) -> tuple:
        """What is drawn: its words and their shards, keys of the questions (replicas x draws), pairs, means and known changes of the texts, and what smooths."""
        messages = right.take(pc.sort_indices(right["shard"]))
        smoothing = added * sum(messages["distinct"].to_pylist())
        counts, totals, kept = (np.concatenate([_counts(p.as_py()) for p in messages[c]]) for c in ("counts", "totals", "kept"))
        ends = np.cumsum(kept)
        names: dict[bytes, int] = {}
        options, reached = np.empty(ends[-1] if ends.size else 0, np.int32), np.zeros(1 + (ends[-1] if ends.size else 0), np.int64)
        at = 0
        for others, second, times in zip(messages["others"], messages["second"], messages["times"], strict=True):
            own = _Shard._known(names, _split(others.as_py()))[_counts(second.as_py())]
            options[at : at + own.size], reached[at + 1 : at + own.size + 1] = own, _counts(times.as_py())
            at += own.size
        np.cumsum(reached, out=reached)  # over the options of all words
        base = reached[ends - kept]
        span = reached[ends] - base
        surprisal = -np.log((totals + added) / (counts[block.before] + smoothing))[block.pair]
        pairs = np.maximum(block.lengths - 1, 0)
        start = np.cumsum(pairs) - pairs
        texts = np.flatnonzero(pairs >= 2)
        hashed, pairs, start = hashed[texts], pairs[texts], start[texts]
        means = np.bincount(np.repeat(np.arange(texts.size), pairs), weights=surprisal[_ranges(start, pairs)], minlength=texts.size) / pairs
        new_names = list(names)
        new_shard = _shards(new_names, shards)
        by_shard = np.argsort(new_shard, kind="stable")
        rank = np.empty(len(new_names), np.int64)
        rank[by_shard] = np.arange(len(new_names))
        picks = many(pairs)
        to = np.append(0, np.cumsum(picks))
        keys = np.empty((replicas, to[-1]), np.int64)
        known = np.zeros((replicas, texts.size))
        for a, b in _steps(pairs):
            n = pairs[a:b] - 1  # inner words
            bits = np.uint64(max(1, int(n.sum())).bit_length())
            text, pair = np.repeat(np.arange(b - a), n), _ranges(start[a:b], n)
            pos = _ranges(np.ones(b - a, np.int64), n).astype(np.uint64)
            chosen_at = _ranges(np.cumsum(n) - n, picks[a:b])
            slots = np.repeat(np.arange(b - a), picks[a:b])
            order_of = text.astype(np.uint64) << (bits + np.uint64(20)) | np.arange(text.size, dtype=np.uint64)
            for replica in range(replicas):
                placed = chained(chained(hashed[a:b], np.array([replica + 1], np.uint64))[text], pos)
                chosen = (np.sort(order_of | _number(placed).astype(np.uint64) << bits)[chosen_at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
                p = pair[chosen]
                word, after = block.flat[block.first[p]], block.flat[block.first[p] + 2]
                target = np.floor(_number(chained(placed[chosen], _DRAW)) / NUMBERS * span[word]).astype(np.int64)
                option = np.searchsorted(reached[1:], base[word] + target, side="right")
                gained = np.log((reached[option + 1] - reached[option] + added) / (counts[word] + smoothing))
                known[replica, a:b] = np.bincount(slots, weights=surprisal[p] + surprisal[p + 1] + gained, minlength=b - a)
                keys[replica, to[a] : to[b]] = rank[options[option]] * len(block.names) + after
        return [new_names[w] for w in by_shard], new_shard[by_shard], keys, texts, pairs, means, known, smoothing

    def drawn(left: pa.Table, right: pa.Table) -> pa.Table:
        block, number = _Block(left, shards), left["block"][0].as_py()
        new_names, new_shard, keys, texts, pairs, means, known, smoothing = made(block, left["hash"].to_numpy().view(np.uint64), right)
        del block.flat, block.first, block.pair, block.before, block.second
        distinct, place = np.unique(keys, return_inverse=True)
        del keys
        new, after = distinct // max(1, len(block.names)), distinct % max(1, len(block.names))
        at = np.searchsorted(new_shard[new], np.arange(shards + 1))
        out = []
        for k, (i, j) in enumerate(zip(at, at[1:], strict=False)):
            if i < j:
                words, fan = np.unique(new[i:j], return_counts=True)
                out.append((k, number, 0.0, b"\n".join([new_names[w] for w in words]), _packed(fan), *block.table_of(after[i:j]), *[None] * len(state)))
        out.append((-1 - number, number, smoothing, *[None] * len(asked), _packed(place.ravel()), _packed(pairs), means.tobytes(), known.tobytes()))
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("smoothing", pa.float64()), *((c, pa.binary()) for c in asked + state)])
        ids = pa.ListArray.from_arrays(pa.array([0] * len(out) + [texts.size], pa.int32()), left["id"].combine_chunks().take(pa.array(texts)))
        return _table(out, schema).append_column("ids", ids)

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        counts, totals = [None] * right.num_rows, [None] * right.num_rows
        if left.num_rows and right.num_rows:
            shard = _Shard(left)
            for i in range(right.num_rows):
                words, fan, others, second = (right[c][i].as_py() for c in asked)
                own = np.fromiter((shard.words[w] for w in _split(words)), np.int64)
                after = np.fromiter((shard.others.get(w, -1) for w in _split(others)), np.int64)[_counts(second)]
                times = shard.found(np.repeat(own, _counts(fan)) << 32 | np.maximum(after, 0))
                counts[i], totals[i] = _packed(shard.counts[own]), _packed(np.where(after < 0, 0, times))
        told = right.drop_columns(["words", "others", "second"])
        return told.append_column("counts", pa.array(counts, pa.binary())).append_column("totals", pa.array(totals, pa.binary()))

    def summed(table: pa.Table) -> pa.Table:
        ordered = table.take(pc.sort_indices(table["shard"]))
        place, sizes, means, known = (ordered[c][0].as_py() for c in state)
        pairs, means = _counts(sizes), np.frombuffer(means)
        known = np.frombuffer(known).reshape(replicas, -1)
        if not pairs.size:
            return pa.table({"id": ordered["ids"].combine_chunks().flatten(), **{c: pa.array([], pa.float64()) for c in ("mean", "change", "std")}})
        values = []
        for i in range(1, ordered.num_rows):
            counts, fan, totals = (_counts(ordered[c][i].as_py()) for c in ("counts", "fan", "totals"))
            values.append(np.log((totals + added) / (np.repeat(counts, fan) + ordered["smoothing"][0].as_py())))
        told = np.concatenate(values)[_counts(place)].reshape(replicas, -1)
        picks = many(pairs)
        changes = (known + np.add.reduceat(told, np.cumsum(picks) - picks, axis=1)) / pairs
        return pa.table({"id": ordered["ids"].combine_chunks().flatten(), "mean": means, "change": changes.mean(axis=0), "std": changes.std(axis=0)})

    binary = lambda *names: ", ".join(f"{n} binary" for n in names)
    # Types of ids are given as they are: a DDL string has no fields that can't be null.
    with_ids = lambda *names: StructType.fromDDL(f"shard int, block int, smoothing double, {binary(*names)}").add("ids", ArrayType(kind))
    listing = rows.groupBy("block").applyInArrow(listed, "shard int, block int, " + binary(*listing_schema.names[2:]))
    totals = listing.groupBy("shard").applyInArrow(added_up, "block int, shard int, distinct bigint, " + binary(*totals_schema.names[3:]))
    draws = rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(drawn, with_ids(*asked, *state))
    # What a block keeps for itself goes along with its questions, under a key of its own.
    told = listing.groupBy("shard").cogroup(draws.groupBy("shard")).applyInArrow(answered, with_ids("fan", *state, "counts", "totals"))
    found = told.groupBy("block").applyInArrow(summed, StructType([StructField("id", kind), *(StructField(c, DoubleType()) for c in ("mean", "change", "std"))]))
    return found.withColumnRenamed("id", id_col)


def _steps(pairs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most STEP words together, or of one text."""
    a, size = 0, 0
    for i, n in enumerate(pairs.tolist()):
        if i > a and size + n > STEP:
            yield a, i
            a, size = i, 0
        size += n
    if a < pairs.size:
        yield a, pairs.size
