"""Documents in blocks, for joins against tables of distinct words.

A word occurs in most texts, so a join row for each (text, word) would be many
times the input. Here a block of some tens of megabytes of texts lists its
distinct words once; what is known of these words comes back to the block, in
compressed chunks, and meets its texts there. Blocks are hash-dealt by row, so
their sizes are even whatever the keys are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.memory import give_back
from penmark.llm.session import total_bytes

BLOCK_BYTES = 16_000_000
#: Lines of a block that make a chunk, and lines of all blocks that a task holds at most.
CHUNK_LINES = 50_000
PENDING_LINES = 400_000


def placed(documents: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block int, id, text binary): each text, zstd-compressed, in one of as many blocks as the input needs."""
    blocks = max(1, -(-total_bytes(documents, text_col) // block_bytes))
    source = documents.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [squeeze.compress(t.as_buffer()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["block", "id", "text"])
        give_back()

    return source.mapInArrow(packed, f"block int, id {source.schema['id'].dataType.simpleString()}, text binary")


def unpacked(texts: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    expand = zstandard.ZstdDecompressor()
    for packed in texts:
        yield expand.decompress(packed.as_py()).decode()


class Chunks:
    """Gathers lines by block and yields full ones as (block, zstd-compressed lines)."""

    SCHEMA = "block int, lines binary"

    def __init__(self) -> None:
        self.lines: dict[int, list[str]] = {}
        self.pending = 0

    def add(self, block: int, line: str) -> Iterator[pa.RecordBatch]:
        own = self.lines.setdefault(block, [])
        own.append(line)
        self.pending += 1
        if len(own) >= CHUNK_LINES:
            self.pending -= len(own)
            yield self._batch({block: self.lines.pop(block)})
        elif self.pending >= PENDING_LINES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for block in list(self.lines):
            yield self._batch({block: self.lines.pop(block)})
        self.pending = 0

    @staticmethod
    def _batch(lines: dict[int, list[str]]) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=3)
        packed = [squeeze.compress("\n".join(x).encode()) for x in lines.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int32()), pa.array(packed, pa.binary())], names=["block", "lines"])


def lines_of(chunks: pa.Table) -> Iterable[str]:
    expand = zstandard.ZstdDecompressor()
    for packed in chunks.column("lines"):
        yield from expand.decompress(packed.as_py()).decode().split("\n")  # a word holds no white space
