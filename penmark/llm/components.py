"""Connected components of a graph of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.session import checkpointed, discard


#: Edges that one task works on without a shuffle; larger graphs are shuffled.
FEW_EDGES = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of `edges` (a, b); the component is its smallest node.

    Each round links every node's larger neighbours to its smallest one, then
    its smaller neighbours likewise, until nothing changes, which takes about
    the logarithm of the longest path. Minima are aggregated before the joins,
    so a hub of any degree is no single task's work. A graph of FEW_EDGES or
    fewer, which are counted, is one task's. Loops, repeated edges and edges
    with a null end are ignored; an empty table has no components. The
    result is a table of its own, which discard() deletes.
    """
    at = checkpointed(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(at)
    while state[0]:
        together = (lambda df: df.coalesce(1)) if state[0] <= FEW_EDGES else (lambda df: df)
        ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        both = together(at).select(ways.alias("way")).select("way.*")
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        before, at = at, checkpointed(together(small.unionByName(least.select("a", F.col("least").alias("b")))).distinct())
        discard(before)
        new = _state(at)
        if new == state:
            break
        state = new
    found = checkpointed(
        at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    )
    discard(at)
    return found
