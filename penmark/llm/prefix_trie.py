"""The prefix trie of conversations by Patricia construction.

Distinct turn sequences are sorted once over all tasks. The lengths of common
prefixes of neighbours are the depths at which sequences branch or end; only
these points are made, each with the edge from the point above it. All sums
over subtrees are taken on that compressed tree, within each task's part of the
order and then by key over the parts that share a point. Nodes with one child,
which lie inside edges, are made last, from the edges' suffix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.llm.session import checkpointed, discard, table

#: Turns in a task's part of the sorted sequences.
PART_TURNS = 200_000
#: Conversation ids 2**ID_BITS apart are joined to the list of a sequence's conversations in different rows.
ID_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a digest that names a turn or a sequence.
_KEY = 16


def _digest(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, _KEY)


def conversation_paths(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, path) of each conversation: its turns in order, each as a digest of role and text and the text's words.

    Turns are ordered by their number, null first, equal ones by digest, so
    repeated rows are turns of their own. A null role or text is an empty one.
    Rows of a null conversation belong to none and are left out. A row holds
    some 30 bytes a turn of its conversation, no texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(
        F.col(turn_col).isNotNull().alias("numbered"),
        F.col(turn_col).alias("turn"),
        _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    ordered = F.array_sort(F.collect_list(turn))
    rows = conversations.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv_id")).agg(ordered.alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("path"))


def _sequences(paths: DataFrame) -> DataFrame:
    """(key, n, first, ends, path) of each distinct path; ends: digest of its conversations' ids.

    The ids of one path, which may be those of most conversations, come in rows
    of 2**ID_BITS and are hashed as they pass.
    """
    name = _digest(F.unhex(F.array_join(F.transform("path", lambda t: F.hex(t["key"])), "")))
    ids = F.sort_array(F.collect_list("conv_id"))
    listed = paths.groupBy(name.alias("key"), F.shiftright("conv_id", ID_BITS).alias("part")).agg(ids.alias("ids"), F.first("path").alias("path"))
    rows = listed.select("key", "part", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "path")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, first, path, digest, schema = None, 0, 0, None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([n]), pa.array([first]), pa.array([digest.hexdigest()]), path], names=["key", "n", "first", "ends", "path"])

        done = []
        for batch in batches:
            for i, (own, count, least, listed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "n", "first", "ids")), strict=True)):
                if own != key:
                    if key is not None:
                        done.append(row())
                    key, n, first, path, digest = own, count, least, batch.column("path").slice(i, 1), hashlib.sha256(listed.encode())
                else:
                    n += count
                    digest.update(f",{listed}".encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if key is not None:
            yield row()

    together = rows.repartition("key").sortWithinPartitions("key", "part")
    return together.mapInArrow(hashed, f"key binary, n bigint, first bigint, ends string, path {paths.schema['path'].dataType.simpleString()}")


def _onto(stack: list[int], depth: int) -> None:
    """The depths of points on a sequence's path, after one that shares `depth` turns with it."""
    while stack and stack[-1] > depth:
        stack.pop()
    if depth and (not stack or stack[-1] < depth):
        stack.append(depth)


def _paths_of(batch: pa.RecordBatch | pa.Table) -> tuple[list[bytes], list[int], list[int]]:
    """The turns' keys and words of all rows, one after the other, and where each row starts."""
    path = batch.column("path")
    path = path.combine_chunks() if isinstance(path, pa.ChunkedArray) else path
    turns = path.flatten()
    return turns.field("key").to_pylist(), turns.field("words").to_pylist(), [0, *np.cumsum(path.value_lengths().to_numpy(zero_copy_only=False)).tolist()]


def _shared(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _sorted_parts(sequences: DataFrame, parts: int) -> DataFrame:
    """`sequences` with part, place in it, shared (turns in common with the row before) and, in a part's last row, what the part does to paths across it.

    least: the fewest turns shared inside; falls and rises: the depths of points
    on its first and last path that come from inside.
    """
    ordered = sequences.repartitionByRange(parts, "path").sortWithinPartitions("path")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before, least, held = TaskContext.get().partitionId(), 0, None, None, None
        falls: list[int] = []
        rises: list[int] = []

        def out(batch: pa.RecordBatch, shared: list[int], start: int, *, last: bool) -> pa.RecordBatch:
            n = len(shared)
            end = lambda value: pa.array([None] * (n - 1) + [value if last else None], pa.list_(pa.int32()))
            more = [
                pa.array([part] * n, pa.int32()), pa.array(range(start, start + n), pa.int64()), pa.array(shared, pa.int32()),
                pa.array([None] * (n - 1) + [least if last else None], pa.int32()), end(falls), end(rises),
            ]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "place", "shared", "least", "falls", "rises"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield out(*held, last=False)
            keys, _, starts = _paths_of(batch)
            shared = []
            for a, b in zip(starts, starts[1:], strict=False):
                own = keys[a:b]
                depth = -1 if before is None else _shared(before, own)
                if depth >= 0:
                    if least is None or depth < least:
                        least = depth
                        falls.append(depth)
                    _onto(rises, depth)
                shared.append(depth)
                before = own
            held = batch, shared, place
            place += len(shared)
        if held:
            yield out(*held, last=True)

    kind = sequences.schema["path"].dataType.simpleString()
    return ordered.mapInArrow(
        marked, f"key binary, n bigint, first bigint, ends string, path {kind}, part int, place bigint, shared int, least int, falls array<int>, rises array<int>"
    )


def _surroundings(sorted_: DataFrame) -> dict[int, tuple[list[int], list[int], int]]:
    """By part: the depths of points on its first path that come from before it, of those on its last path that come from behind it, and the turns that its last path shares with the next.

    Only parts' first and last rows are looked at, two for each part; numbers alone come to the driver.
    """
    edge = sorted_.where("place = 0 OR falls IS NOT NULL")
    before = F.lag("path").over(Window.orderBy("part", "place"))
    differs = F.array_position(F.zip_with("path", "before", lambda x, y: ~x["key"].eqNullSafe(y["key"])), F.lit(True))
    common = F.when(differs == 0, F.size("path")).otherwise(differs - 1)
    rows = (
        edge.withColumn("before", before)
        .select("part", "place", F.when(F.col("before").isNotNull(), common).cast("int").alias("common"), "least", "falls", "rises")
        .orderBy("part", "place")
        .collect()
    )
    entry: dict[int, int] = {}
    ends = []
    for r in rows:
        if r["place"] == 0:
            entry[r["part"]] = r["common"] if r["common"] is not None else 0
        if r["falls"] is not None:
            ends.append(r)
    found: dict[int, tuple[list[int], list[int], int]] = {}
    stack: list[int] = []
    for r in ends:
        _onto(stack, entry[r["part"]])
        found[r["part"]] = list(stack), [], -1
        if r["least"] is not None:
            _onto(stack, r["least"])
        for depth in r["rises"]:
            _onto(stack, depth)
    stack, after = [], None
    for r in reversed(ends):
        if after is not None:
            if after["least"] is not None:
                _onto(stack, after["least"])
            for depth in reversed(after["falls"]):
                _onto(stack, depth)
            _onto(stack, entry[after["part"]])
            found[r["part"]] = found[r["part"]][0], list(stack), entry[after["part"]]
        after = r
    return found


def _points(sorted_: DataFrame) -> DataFrame:
    """The points of each part's paths, in preorder, with what the part knows of them.

    node and stop: the part's numbers of the point and of the first behind its
    subtree; above: that of the point over it; sums: for each turn of the edge,
    the words from it to the edge's end (for the root a single 0).
    """
    around = sorted_.sparkSession.sparkContext.broadcast(_surroundings(sorted_))

    def grown(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        part = rows.column("part")[0].as_py()
        left, right, next_shared = around.value[part]
        keys, words, starts = _paths_of(rows)
        n = rows.num_rows
        shared = [left[-1] if left else 0, *rows.column("shared").to_pylist()[1:], next_shared]
        right, depths_behind = list(right), [()] * n
        for i in range(n - 1, -1, -1):
            if i < n - 1:
                _onto(right, shared[i + 1])
            depths_behind[i] = tuple(right)
        left = list(left)
        depth, key, above, count, first, leaves, ends, sums = ([] for _ in range(8))
        path: list[int] = []
        for i, (n_own, first_own, ends_own) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("n", "first", "ends")), strict=True)):
            a, b = starts[i], starts[i + 1]
            if i:
                _onto(left, shared[i])
            while path and i and depth[path[-1]] > shared[i]:
                path.pop()
            digest, hashed = hashlib.sha256(), 0
            for d in sorted({0, *left, *depths_behind[i], b - a}):
                if path and d <= depth[path[-1]]:
                    continue
                digest.update(b"".join(keys[a + hashed : a + d]))
                hashed = d
                edge = words[a + depth[path[-1]] : a + d] if path else [0]
                for column, value in ((depth, d), (key, digest.digest()[:_KEY]), (above, path[-1] if path else -1), (count, 0), (first, None), (leaves, 0), (ends, None)):
                    column.append(value)
                sums.append(np.cumsum(edge[::-1])[::-1].tolist())
                path.append(len(depth) - 1)
            end = path[-1]
            count[end], first[end], ends[end] = n_own, first_own, ends_own
            leaves[end] = int(shared[i + 1] != b - a)
        stop = list(range(1, len(depth) + 1))
        for v in range(len(depth) - 1, 0, -1):
            u = above[v]
            count[u], leaves[u], stop[u] = count[u] + count[v], leaves[u] + leaves[v], max(stop[u], stop[v])
            first[u] = first[v] if first[u] is None else min(first[u], first[v])
        columns = [
            pa.array([part] * len(depth), pa.int32()), pa.array(range(len(depth)), pa.int64()), pa.array(stop, pa.int64()), pa.array(above, pa.int64()), pa.array(depth, pa.int64()),
            pa.array(key, pa.binary()), pa.array(count, pa.int64()), pa.array(first, pa.int64()), pa.array(leaves, pa.int64()), pa.array(ends, pa.string()), pa.array(sums, pa.list_(pa.int64())),
        ]
        return pa.Table.from_arrays(columns, names=["part", "node", "stop", "above", "depth", "key", "n", "first", "leaves", "ends", "sums"])

    schema = "part int, node bigint, stop bigint, above bigint, depth bigint, key binary, n bigint, first bigint, leaves bigint, ends string, sums array<bigint>"
    return sorted_.select("part", "place", "shared", "n", "first", "ends", "path").groupBy("part").applyInArrow(grown, schema)


def _summed(points: DataFrame) -> DataFrame:
    """One row for each point of the whole trie: key, depth, n, first, leaves, ends, sums, children, above_first, below (tokens saved under it)."""
    whole = points.groupBy("key").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("leaves").alias("leaves"), F.max("ends").alias("ends"), F.min("part").alias("owner")
    )
    known = points.select("part", "node", "stop", "above", "depth", "key", "sums").join(whole, "key")

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        n, first, above, stop = (rows.column(c).to_numpy() for c in ("n", "first", "above", "stop"))
        owned = rows.column("owner").to_numpy() == rows.column("part").to_numpy()
        words = np.array([s[0].as_py() for s in rows.column("sums")], dtype=np.int64)
        # Each point's edge counts in one part, that which holds its first path; the root's edge has no words.
        upto = np.concatenate([[0], np.cumsum(np.where(owned, (n - 1) * words, 0))])
        below = upto[stop] - upto[np.arange(n.size) + 1]
        children = np.bincount(above[owned & (above >= 0)], minlength=n.size).astype(np.int64)
        own = pa.array(owned)
        parents = pa.array(first[np.maximum(above, 0)], pa.int64(), mask=(above < 0) | ~owned)
        kept = [pa.compute.if_else(own, rows.column(c).combine_chunks(), pa.scalar(None, rows.column(c).type)) for c in ("depth", "n", "first", "leaves", "ends", "sums")]
        return pa.Table.from_arrays(
            [rows.column("key").combine_chunks(), *kept, pa.array(children), parents, pa.array(below)],
            names=["key", "depth", "n", "first", "leaves", "ends", "sums", "children", "above_first", "below"],
        )

    schema = "key binary, depth bigint, n bigint, first bigint, leaves bigint, ends string, sums array<bigint>, children bigint, above_first bigint, below bigint"
    parts = known.groupBy("part").applyInArrow(added, schema)
    once = [F.first(c, ignorenulls=True).alias(c) for c in ("depth", "n", "first", "leaves", "ends", "sums", "above_first")]
    return parts.groupBy("key").agg(*once, F.sum("children").alias("children"), F.sum("below").alias("below"))


def prefix_trie(paths: DataFrame, *, parts: int = 1) -> DataFrame:
    """All nodes of the trie of `paths` (conv_id long, path as of conversation_paths).

    Each distinct sequence of first turns is a node, the empty one its root.
    Its members are the conversations that start with it. Returns a row for
    each node: conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves (nodes without children in its
    subtree, itself included), saved_tokens (over its subtree, words of a node's
    last turn times members but one) and ends_sha256 (of the comma-joined
    ascending ids of the members that end there; of an empty string if none).
    Conversations without turns end at the root; without conversations there
    are no rows. conv_id must be unique and not null. `parts` is the number of
    tasks over which the sorted sequences are dealt.
    """
    sorted_ = checkpointed(_sorted_parts(_sequences(paths), parts))
    points = checkpointed(_points(sorted_))
    discard(sorted_)
    point = F.col("pos") == F.size("sums") - 1
    none = hashlib.sha256(b"").hexdigest()
    return (
        _summed(points)
        .select("*", F.posexplode("sums").alias("pos", "words"))
        .select(
            F.col("first").alias("conv_id"),
            (F.col("depth") - F.size("sums") + 1 + F.col("pos")).alias("depth"),
            F.when(F.col("pos") == 0, F.col("above_first")).otherwise(F.col("first")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(point, F.col("children")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("below") + (F.col("n") - 1) * F.col("words")).alias("saved_tokens"),
            F.when(point, F.coalesce("ends", F.lit(none))).otherwise(none).alias("ends_sha256"),
        )
    )


def with_shared_starts(paths: DataFrame) -> DataFrame:
    """Each conversation c started with the first h turns of conversation c - c % 20 in place of its own, h = crc32(decimal c) % 4.

    Of a conversation with fewer turns all are taken, of one that is absent none.
    """
    heads = paths.where("conv_id % 20 = 0").select(F.col("conv_id").alias("of"), F.slice("path", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    joined = paths.withColumn("of", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "of", "left")
    start = F.when(F.col("head").isNull(), F.slice("path", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    return joined.select("conv_id", F.concat(start, F.slice("path", h + 1, F.size("path"))).alias("path"))


def op12_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    paths = checkpointed(conversation_paths(conversations))
    return prefix_trie(with_shared_starts(paths), parts=max(1, -(-conversations.count() // PART_TURNS)))


#: Every prefix is a row; sums over subtrees go from each node to all its prefixes.
OP12_SQL = r"""
WITH given AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS path
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
      lambda i: [ascii((conv_id::VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 4 AS h
  FROM given),
paths AS (
  SELECT c.conv_id, list_concat(coalesce(s.path[1:c.h], []), c.path[c.h + 1:]) AS path
  FROM hashed c LEFT JOIN given s ON s.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (SELECT conv_id, d, path[1:d] AS path, len(path) = d AS whole FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d),
families AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n - 1) * CASE WHEN d > 0 THEN len(regexp_extract_all(nodes.path[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
  FROM nodes LEFT JOIN families USING (path)),
subtrees AS (
  SELECT path[1:k] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS k FROM full_) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN subtrees USING (path) LEFT JOIN nodes p ON p.path = f.path[1:f.d - 1] AND f.d > 0
"""
