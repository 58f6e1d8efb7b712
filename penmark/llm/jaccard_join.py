"""N-gram Jaccard join by filtering under several global token orders.

Texts with equal shingle sets are one node. Under a global order of all
shingles, two sets of Jaccard similarity 0.75 or more share one of the first
n - ceil(0.75 n) + 1 shingles of each, and what they share there bounds what
they can share at all. The first order (shingles that recur last, the most
frequent at the very end, else by hash) makes candidates by a join on those
prefixes. Pairs stay candidates only if their prefixes under two further orders
meet too; whole texts of what is left are compared.

Groups of near copies would make a pair of each two members. So each node is
first compared with a few partners that have the same least shingles under
several hash orders; components of the links found are then one class. Only members of different classes are paired, which loses no link
between classes. Of the candidates, the best of each node is compared first,
then those still across classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from penmark.llm.components import connected_components
from penmark.llm.memory import give_back
from penmark.llm.session import checkpointed, discard, table, total_bytes
from penmark.llm.textbytes import NOT_SPACE, Words, mix, pieces, string_buffer

SHINGLE = 5
#: Similarity as a fraction, so that set sizes are compared in whole numbers.
NUMERATOR, DENOMINATOR = 3, 4
PIECE_BYTES = 750_000
#: Recurring shingles that the first order ranks by count, at most; those that recur most.
#: Counts are sums over spans of SURVEY_BYTES of text, of what occurs in several sets of a span.
HOT = 1 << 20
SURVEY_BYTES = 16_000_000
#: Rows of 8 to 40 bytes that may be broadcast; larger tables are shuffled.
BROADCAST_ROWS = 500_000
#: Packed texts that may be broadcast.
BROADCAST_BYTES = 24_000_000
#: Salts of the further orders.
FURTHER = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Salts of the orders whose least shingles find a partner, and how many of these must agree.
LEAST = np.random.default_rng(20240503).integers(1, 1 << 63, 8, dtype=np.uint64)
AGREEING = 3
#: Rounds of comparing each node with so many partners at most; in the later ones only few nodes are left that look for one.
PARTNERS = (3, 8)
_PLACES = np.random.default_rng(20240502).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle."""
    words = Words(raw, offsets, NOT_SPACE)
    h = words.hash
    run = np.zeros(h.size, dtype=np.uint64)
    for j in range(min(SHINGLE, h.size)):
        run[: h.size - j] += h[j:] * _PLACES[j]
    run = mix(run + np.uint64(SHINGLE))
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(run[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(np.sum(h[a:b] * _PLACES[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def _node(tokens: np.ndarray) -> np.int64:
    """A hash of a whole set."""
    return np.bitwise_xor.reduce(mix(tokens + np.uint64(tokens.size)), initial=np.uint64(tokens.size)).view(np.int64)


def _least(sets: list[np.ndarray]) -> np.ndarray:
    """The least shingle of each set under each order of LEAST; an empty set has a zero."""
    whole = np.concatenate([s if s.size else np.zeros(1, np.uint64) for s in sets])
    first = np.cumsum([0, *(max(1, s.size) for s in sets[:-1])])
    return np.column_stack([np.minimum.reduceat(mix(whole ^ salt), first) for salt in LEAST]).view(np.int64)


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


class Order:
    """The first global order: by hash, but the ranked shingles behind all others, the most frequent last."""

    def __init__(self, hot: np.ndarray):
        """hot: recurring shingles, the most frequent first."""
        order = np.argsort(hot)
        self.hot, self.rank = hot[order], (hot.size - order).astype(np.int32)

    def prefixes(self, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The prefix of each set in order, and which of it is ranked. Sets are sorted, so ties go to the smaller shingle."""
        whole = np.concatenate(sets)
        rank = np.zeros(whole.size, dtype=np.uint64)
        if self.hot.size:
            at = np.minimum(np.searchsorted(self.hot, whole), self.hot.size - 1)
            found = self.hot[at] == whole
            rank[found] = self.rank[at[found]]
        key = rank << np.uint64(40) | mix(whole) >> np.uint64(24)
        first = 0
        for s in sets:
            order = np.argsort(key[first : first + s.size], kind="stable")[: prefix_length(s.size)]
            yield s[order], rank[first : first + s.size][order] > 0
            first += s.size


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    raw, offsets = string_buffer(batch.column(1))
    for low, high in pieces(offsets, PIECE_BYTES):
        part = offsets[low : high + 1]
        yield low, high, shingle_sets(raw[part[0] : part[-1]], part - part[0])


def _surveyed(source: DataFrame) -> DataFrame:
    """A row (id, row, n, node, mins) for each text, and rows (token, count) of what a span of texts holds several times."""

    def rows(names: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, np.ndarray] = {}
        size = 0

        def often() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(list(gathered.values())), return_counts=True)
            token, count = token[count > 1].view(np.int64), count[count > 1]
            return rows({"token": pa.array(token), "count": pa.array(count, pa.int64())}, token.size)

        for batch in batches:
            for low, high, sets in _sets(batch):
                nodes = [int(_node(s)) for s in sets]
                own = batch.slice(low, high - low)
                counts = pa.array([s.size for s in sets], pa.int64())
                mins = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * LEAST.size, pa.int32()), pa.array(_least(sets).ravel()))
                yield rows({"id": own.column(0), "row": own.column(2), "n": counts, "node": pa.array(nodes, pa.int64()), "mins": mins}, high - low)
                gathered.update(zip(nodes, sets, strict=True))
                size += sum(s.size for s in sets) * 6
                if size > SURVEY_BYTES:
                    yield often()
                    gathered, size = {}, 0
        if gathered:
            yield often()
        gathered = {}
        give_back()

    id_type = to_arrow_type(source.schema["id"].dataType)
    schema = pa.schema([("id", id_type), ("row", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("mins", pa.list_(pa.int64())), ("token", pa.int64()), ("count", pa.int64())])
    kind = source.schema["id"].dataType.simpleString()
    return checkpointed(source.mapInArrow(survey, f"id {kind}, row bigint, n bigint, node bigint, mins array<bigint>, token bigint, count bigint"))


def _recurring(surveyed: DataFrame, hot: int) -> np.ndarray:
    """At most `hot` shingles that occur most often, the most frequent first: all with at least some count."""
    counts = surveyed.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count"))
    counts = checkpointed(counts)
    least, kept = None, 0
    for count, tokens in counts.groupBy("count").agg(F.count("*").alias("tokens")).orderBy(F.desc("count")).collect():
        kept += tokens
        if kept > hot:
            break
        least = count
    found = counts.where(F.col("count") >= least).toArrow() if least else None
    discard(counts)
    if found is None:
        return np.zeros(0, dtype=np.uint64)
    token, count = found.column("token").to_numpy(), found.column("count").to_numpy()
    return token[np.lexsort((token, -count))].view(np.uint64)


def _index(source: DataFrame, hot: np.ndarray) -> DataFrame:
    """(token, node, n, pos, hot): the prefix of each set under the first order, once a task for equal sets."""
    sent = source.sparkSession.sparkContext.broadcast(Order(hot))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, sets in _sets(batch):
                of_node = {int(_node(s)): s for s in sets if s.size}
                nodes = [node for node in of_node if node not in seen]
                if not nodes:
                    continue
                seen.update(nodes)
                sizes = [of_node[node].size for node in nodes]
                tokens, flags = zip(*sent.value.prefixes([of_node[node] for node in nodes]), strict=True)
                length = [t.size for t in tokens]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(nodes), length)),
                    pa.array(np.repeat(np.array(sizes, dtype=np.int32), length)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in length])),
                    pa.array(np.concatenate(flags)),
                ], names=["token", "node", "n", "pos", "hot"])
            if len(seen) > 1_000_000:
                seen.clear()
        give_back()

    return source.mapInArrow(indexed, "token bigint, node bigint, n int, pos int, hot boolean")


def _shared(index: DataFrame) -> DataFrame:
    """(token, node, n, pos, inner) of shingles in the prefixes of several nodes, and of all ranked ones.

    The rows of a shingle that is not ranked, which are few, meet in one task;
    they go if it is inner to none. Those of ranked ones, which may stand in a
    third of all sets, stay spread by node; whether several nodes hold one is
    left to the joins.
    """
    place = F.when(F.col("hot"), F.xxhash64("token", "node")).otherwise(F.col("token"))
    dealt = index.repartition(place).withColumn("place", place)
    dealt = dealt.withColumn("inner", F.col("pos") <= F.col("n") - _needed(F.col("n"), F.col("n")))
    window = "OVER (PARTITION BY place)"
    held = dealt.withColumn("several", F.expr(f"min(node) {window} <> max(node) {window} AND max(inner) {window}")).where("hot OR several")
    return held.dropDuplicates(["place", "token", "node"]).select("token", "node", "n", "pos", "inner")


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` to be broadcast if it has no more than BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _needed(n: Column, m: Column) -> Column:
    """Common shingles that similar sets of these sizes have at least."""
    return F.ceil((n + m) * F.lit(NUMERATOR) / F.lit(NUMERATOR + DENOMINATOR)).cast("long")


def _within_prefixes() -> Column:
    """Whether a shared shingle is in the prefixes that the sizes of both its nodes leave."""
    needed = _needed(F.col("n_a"), F.col("n_b"))
    return (F.col("pos_a") <= F.col("n_a") - needed) & (F.col("pos_b") <= F.col("n_b") - needed)


def _near_in_size(n: str, m: str) -> Column:
    return (F.col(n) * DENOMINATOR >= F.col(m) * NUMERATOR) & (F.col(m) * DENOMINATOR >= F.col(n) * NUMERATOR)


def _bounded(pairs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, common) of the pairs whose shared prefix leaves enough room, from a row for each shared shingle."""
    grouped = pairs.groupBy("a", "b").agg(
        F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.count("*").alias("common"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b")
    )
    # Both see their common shingles in the same order: all up to the last shared one are counted.
    room = F.col("common") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1
    return grouped.where(room >= _needed(F.col("n_a"), F.col("n_b"))).select("a", "b", "n_a", "n_b", "common")


def _fetched(pairs: DataFrame, source: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, second, third, text) of the ends of the pairs (a, b): prefixes under the further orders, as 32 bits of each shingle, and the packed text."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = checkpointed(nodes.join(ends, "node", "left_semi").select("node", F.col("id").alias("of_id"), F.col("row").alias("of_row")))
    texts = source.join(_small(wanted), (F.col("row") == F.col("of_row")) & F.col("id").eqNullSafe(F.col("of_id"))).select("node", "text")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        seen: set[int] = set()  # repeated rows
        for batch in batches:
            new = [node for node in dict.fromkeys(batch.column(0).to_pylist()) if node not in seen]
            batch = batch.take(pc.index_in(pa.array(new, pa.int64()), batch.column(0)))
            seen.update(new)
            for low, high, sets in _sets(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["node", "text"])):
                own = batch.slice(low, high - low)
                prefixes = []
                for salt in FURTHER:
                    first = [s[np.argsort(mix(s ^ np.uint64(salt)))[: prefix_length(s.size)]].astype(np.uint32).view(np.int32) for s in sets]
                    prefixes.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate(first))))
                packed = pa.array([squeeze.compress(t.as_buffer()) for t in own.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), *prefixes, packed], names=["node", "second", "third", "text"])
        give_back()

    held = checkpointed(texts.mapInArrow(signed, "node bigint, second array<int>, third array<int>, text binary"))
    if held.count() != wanted.count():  # rows that repeat across tasks
        held, repeated = checkpointed(held.dropDuplicates(["node"])), held
        discard(repeated)
    discard(wanted)
    return held


def _meeting(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs whose prefixes meet under every further order."""

    def side(x: str) -> DataFrame:
        return held.select(F.col("node").alias(x), F.col("second").alias(f"second_{x}"), F.col("third").alias(f"third_{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select(*pairs.columns)


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar as whole sets."""

    def side(x: str) -> DataFrame:
        return held.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))

    def sets_of(texts: pa.Array) -> list[np.ndarray]:
        expand = zstandard.ZstdDecompressor()
        raw = [np.frombuffer(expand.decompress(t.as_buffer()), np.uint8) for t in texts]
        return shingle_sets(np.concatenate(raw), np.cumsum([0, *map(len, raw)]))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            weight = pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy(zero_copy_only=False)
            for low, high in pieces(np.concatenate([[0], np.cumsum(weight, dtype=np.int64)]), PIECE_BYTES):
                x, y = (sets_of(batch.column(c).slice(low, high - low)) for c in (2, 3))
                similar += map(_similar, x, y)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(similar, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])
        give_back()

    ends = side("b").join(pairs.select("b").distinct(), "b", "left_semi")
    if held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] > BROADCAST_BYTES:
        leaders = checkpointed(ends)  # often few, as many nodes share one
        size = leaders.agg(F.coalesce(F.sum(F.length("text_b")), F.lit(0))).first()[0]
        ends = F.broadcast(leaders) if size <= BROADCAST_BYTES else leaders
    else:
        ends = F.broadcast(ends)
    both = pairs.select("a", "b").join(side("a"), "a").join(ends, "b").select("a", "b", "text_a", "text_b")
    return checkpointed(both.mapInArrow(compared, "a bigint, b bigint"))


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    common = np.intersect1d(x, y, assume_unique=True).size
    return common * DENOMINATOR >= (x.size + y.size - common) * NUMERATOR


def _with_classes(rows: DataFrame, members: DataFrame | None) -> DataFrame:
    if members is None:
        return rows.withColumn("class", F.col("node"))
    members = _small(members)
    return rows.join(members.select("node", F.col("component").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))


def _kin(nodes: DataFrame) -> DataFrame:
    """(order, token, node, holders) of the least shingles that several nodes have; holders: of all those of the node."""
    each = nodes.select("node", F.posexplode("mins").alias("order", "token"))
    several = each.groupBy("order", "token").agg(F.count("*").alias("holders")).where("holders > 1")
    shared = checkpointed(each.join(several, ["order", "token"]))
    kin = checkpointed(shared.drop("holders").join(shared.groupBy("node").agg(F.sum("holders").alias("holders")), "node"))
    discard(shared)
    return kin


def _partners(kin: DataFrame, nodes: DataFrame, step: int, most: int) -> DataFrame:
    """(a, b): for each node the `most` likeliest partners of other classes, as large or larger, among those with the same least shingles.

    Of all nodes with a least shingle one stands for them, so there is a row for
    each node and order at most: that whose least shingles have most holders,
    which is near the middle of its group, of another part of the nodes in each
    order and step. Partners with most least shingles in common are likeliest.
    """
    part = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(LEAST.size))
    by = (part != F.col("order")).alias("by"), (-F.col("holders")).alias("then"), F.xxhash64("node", F.lit(step)).alias("last")
    leaders = kin.groupBy("order", "token").agg(F.min(F.struct(*by, "node")).alias("leader"))
    met = kin.join(_small(checkpointed(leaders.select("order", "token", F.col("leader.node").alias("b")))), ["order", "token"]).where("node <> b")
    met = met.select(F.col("node").alias("a"), "b").distinct()
    nodes = nodes.join(_small(checkpointed(nodes.groupBy("class").agg(F.count("*").alias("size")))), "class")
    sides = [nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "class", "size", "mins")]) for x in "ab"]
    pairs = met.join(sides[0], "a").join(sides[1], "b").where((F.col("class_a") != F.col("class_b")) & (F.col("size_a") <= F.col("size_b")) & _near_in_size("n_a", "n_b"))
    orders = F.size(F.filter(F.zip_with("mins_a", "mins_b", lambda x, y: x == y), lambda same: same)).alias("orders")
    agreeing = pairs.select("a", "b", orders).where(F.col("orders") >= AGREEING)
    best = agreeing.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("orders", "b")), asc=False), 1, most).alias("best"))  # of a leader an order at most
    return checkpointed(best.select("a", F.explode("best.b").alias("b")))


def _open(rows: DataFrame) -> DataFrame:
    """The rows of shingles that may still pair several classes."""
    classes = rows.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("inner").alias("inner"))
    return rows.join(classes.where("low <> high AND inner").select("token"), "token", "left_semi")


def _pairs_across(rows: DataFrame) -> DataFrame:
    """A row for each two nodes of different classes, near in size, and each shingle in the prefixes of both.

    The smaller set of a similar pair has its shared shingles among its inner
    ones. Classes are paired by shingle first, then the sizes and places that
    their members have there, and members are joined to those last: members of
    one class never meet, and those alike in size and place count as one till
    sizes and places are judged.
    """
    keys = ["token", "class", "n", "pos"]
    alike = checkpointed(rows.groupBy(*keys, "inner").agg(F.min("node").alias("node"), F.count("*").alias("many")))
    several = checkpointed(rows.join(_small(alike.where("many > 1").select(*keys)), keys, "left_semi").select(*keys, "node"))

    def side(own: DataFrame, x: str) -> DataFrame:
        return own.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "node", "n", "pos", "many")])

    def classes(members: DataFrame, x: str) -> DataFrame:
        return members.groupBy("token", f"class_{x}").agg(F.min(f"n_{x}").alias(f"low_{x}"), F.max(f"n_{x}").alias(f"high_{x}"), F.min(f"pos_{x}").alias(f"first_{x}"))

    def reaches(x: str, y: str) -> Column:
        return F.col(f"first_{x}") <= F.col(f"high_{x}") - _needed(F.col(f"high_{x}"), F.col(f"low_{y}"))

    def expanded(pairs: DataFrame, members: DataFrame, x: str) -> DataFrame:
        own = members.select("token", *[F.col(c).alias(f"{c}_{x}") for c in keys[1:]], F.col("node").alias("member"))
        joined = pairs.join(own, [c if c == "token" else f"{c}_{x}" for c in keys], "left")
        return joined.withColumn(f"node_{x}", F.coalesce("member", f"node_{x}")).drop("member")

    small, large = side(alike.where("inner"), "a"), side(alike, "b")
    sized = (F.col("low_a") <= F.col("high_b")) & (F.col("high_a") * DENOMINATOR >= F.col("low_b") * NUMERATOR)
    met = classes(small, "a").join(classes(large, "b"), "token").where((F.col("class_a") != F.col("class_b")) & sized & reaches("a", "b") & reaches("b", "a"))
    pairs = met.select("token", "class_a", "class_b").join(small, ["token", "class_a"]).join(large, ["token", "class_b"])
    pairs = pairs.where((F.col("n_a") <= F.col("n_b")) & (F.col("n_a") * DENOMINATOR >= F.col("n_b") * NUMERATOR) & _within_prefixes())
    if not several.isEmpty():
        several = _small(several)
        pairs = expanded(expanded(pairs, several, "a"), several, "b")
    pairs = pairs.where("n_a < n_b OR node_a < node_b")
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b", "pos_a", "pos_b")


class _Links:
    """The classes (node, component) that the links found so far make."""

    def __init__(self) -> None:
        self.members: DataFrame | None = None

    def add(self, found: DataFrame) -> None:
        """Takes in the links (a, b), a table of its own, which is deleted."""
        before = self.members
        if not found.isEmpty():
            known = found if before is None else found.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
            self.members = connected_components(known)
            discard(before)
        discard(found)

    def across(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) whose ends are in different classes."""
        if self.members is None:
            return pairs
        of = self.members.select("node", "component")
        pairs = pairs.join(of.select(F.col("node").alias("a"), F.col("component").alias("of_a")), "a", "left")
        pairs = pairs.join(of.select(F.col("node").alias("b"), F.col("component").alias("of_b")), "b", "left")
        return pairs.where("coalesce(of_a, a) <> coalesce(of_b, b)").drop("of_a", "of_b")


def similar_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The class of each text under similarity links of 0.75 or more over five-word shingles.

    Returns for each row: id_col, n_shingles (long) and component_id, the
    smallest id that links reach. A null, empty or blank text has no shingles
    and no links; one of fewer words is a single shingle. Equal rows stay apart
    and share a class; a null id takes part, but names no class unless all are
    null. Sets are compared by 64-bit hashes of their shingles. Other columns
    are not read.
    """
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    # Many small partitions show a task too little of what recurs.
    spans = max(2 * source.sparkSession.sparkContext.defaultParallelism, -(-total_bytes(source, "text") // (2 * SURVEY_BYTES)))
    surveyed = _surveyed(source.coalesce(spans))
    texts = surveyed.where("n IS NOT NULL").select("id", "row", "n", "node")
    of_node = surveyed.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "row")).alias("of"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    nodes = checkpointed(of_node.select("node", F.col("of.id").alias("id"), F.col("of.row").alias("row"), "least", "n", "mins"))

    links, kin = _Links(), _kin(nodes)
    near = checkpointed(nodes.join(kin.select("node").distinct(), "node", "left_semi").select("node", "n", "mins"))
    for step, most in enumerate(PARTNERS):
        found = _partners(kin, _with_classes(near, links.members), step, most)
        held = _fetched(found, source, nodes)
        links.add(_verified(_meeting(found, held), held))
        discard(found, held)
    discard(kin, near)

    shared = checkpointed(_shared(_index(source.select("id", "text"), _recurring(surveyed, hot))))
    rows = checkpointed(_open(_with_classes(shared, links.members)))
    candidates = checkpointed(_bounded(_pairs_across(rows)))
    discard(shared, rows)
    held = _fetched(candidates, source, nodes)
    meeting = checkpointed(_meeting(candidates, held))
    best = meeting.groupBy("a").agg(F.max(F.struct("common", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    links.add(_verified(best, held))
    links.add(_verified(links.across(meeting.join(best, ["a", "b"], "left_anti")), held))
    discard(candidates, held, meeting)

    class_of = nodes.select("node", "least")
    class_of = _with_classes(class_of, links.members)
    named = class_of.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = class_of.join(named, "class").select("node", "component_id")
    return texts.join(classes, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component_id", "id")).alias("component_id")
    )


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i + 1 : i + 5], ' ') FOR i IN range(len(w) - 4)]) END AS grams
  FROM d),
same AS (SELECT min(doc_id) AS rep, list(doc_id) AS docs, grams FROM (SELECT doc_id, list_sort(grams) AS grams FROM s) GROUP BY grams),
e AS (SELECT rep, len(grams) AS n, unnest(grams) AS g FROM same),
shared AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
k AS (SELECT rep, n, g FROM e SEMI JOIN shared USING (g)),
linked AS (
  SELECT a.rep AS a, b.rep AS b FROM k a JOIN k b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached(rep, other) AS (
  SELECT rep, rep FROM same
  UNION SELECT r.rep, l.b FROM reached r JOIN both_ways l ON r.other = l.a),
classes AS (SELECT rep, min(other) AS component_id FROM reached GROUP BY rep)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, CASE WHEN len(grams) = 0 THEN doc_id ELSE component_id END AS component_id
FROM (SELECT rep, unnest(docs) AS doc_id, grams FROM same) JOIN classes USING (rep)
"""
