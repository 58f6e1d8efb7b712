"""Texts as lossless images: stored as WebP files, read back into pixel arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.session import table
from penmark.llm.textbytes import string_buffer
from penmark.llm.webp import LARGEST_SIDE, decode, write_grey

UNIT = 64
#: Files are handed on in batches of about this many bytes of samples.
BATCH_BYTES = 8_000_000
#: Samples of one image at most; longer payloads are stored as several files, one after the other.
IMAGE_BYTES = LARGEST_SIDE // UNIT * UNIT * LARGEST_SIDE


def image_shape(n_bytes: int) -> tuple[int, int]:
    """Height and width for up to IMAGE_BYTES samples: 64 wide, or wider so that the height fits the format."""
    width = UNIT
    while n_bytes > width * LARGEST_SIDE:
        width = min(2 * width, LARGEST_SIDE // UNIT * UNIT)
    return -(-n_bytes // width), width


def as_files(text: np.ndarray, image_bytes: int = IMAGE_BYTES) -> bytes:
    """The payload of a text as one file, or as several in a row if it is longer than an image holds."""
    files = []
    for low in range(0, max(1, text.size), image_bytes):
        part = text[low : low + image_bytes]
        samples = np.zeros(image_shape(max(UNIT, -(-part.size // UNIT) * UNIT)), dtype=np.uint8)
        samples.ravel()[: part.size] = part
        files.append(write_grey(samples))
    return b"".join(files)


def split_files(media: bytes) -> list[bytes]:
    """The files that stand in a row, by the size that each one's header tells."""
    files, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        files.append(media[at:end])
        at = end
    return files


def _batched(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Record batches of the rows; column `weight` holds the bytes that fill a batch."""
    kept: list[tuple] = []
    size = 0
    for row in rows:
        kept.append(row)
        size += len(row[weight] or b"")
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), schema.types, strict=True)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), schema.types, strict=True)], schema=schema)


def store_texts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a WebP file: id_col, n_bytes (long) and media (binary).

    The payload is the text in UTF-8 with zero bytes up to a positive multiple
    of 64; a null text counts as empty. One sample is one byte. Payloads over a
    megabyte get wider images, whose last row may hold more zero bytes than the
    payload; those over IMAGE_BYTES several files in a row. Repeated rows and null
    ids are stored like all others; further columns are not read.
    """
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffer(batch.column(1))
            schema = pa.schema([("id", batch.schema.types[0]), ("n_bytes", pa.int64()), ("media", pa.binary())])

            def rows(ids=batch.column(0).to_pylist(), raw=raw, offsets=offsets):
                for i, key in enumerate(ids):
                    text = raw[offsets[i] : offsets[i + 1]]
                    yield key, text.size, as_files(text)

            yield from _batched(rows(), schema, 2)

    return source.mapInArrow(files, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def read_media(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Decodes the files of store_texts(): its columns, and width, height, colours (int), pixels (binary).

    pixels has the payload's samples row by row. Of several files in a row,
    width is that of the first and height counts the rows of all. A null file
    gives nulls.
    """
    source = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    kind = source.schema["id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([
                ("id", batch.schema.types[0]), ("n_bytes", pa.int64()), ("media", pa.binary()),
                ("width", pa.int32()), ("height", pa.int32()), ("colours", pa.int32()), ("pixels", pa.binary()),
            ])

            def rows(batch=batch):
                for key, n, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file is None:
                        yield key, n, None, None, None, None, None
                        continue
                    images = [(decode(f) >> np.uint32(8)).astype(np.uint8) for f in split_files(file)]
                    green = np.concatenate([i.ravel() for i in images])[: max(UNIT, -(-n // UNIT) * UNIT)]
                    colours = np.count_nonzero(np.bincount(green, minlength=256))
                    yield key, n, file, images[0].shape[1], sum(i.shape[0] for i in images), colours, green.tobytes()

            yield from _batched(rows(), schema, 2)

    schema = f"id {kind}, n_bytes bigint, media binary, width int, height int, colours int, pixels binary"
    return source.mapInArrow(decoded, schema).withColumnRenamed("id", id_col)


def op8_media_columns(spark, sf_dir: str) -> DataFrame:
    read = read_media(store_texts(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("webp %dx%d, %d values, crc %08x", "width", "height", "colours", F.crc32("pixels")).alias("feature"),
    )
