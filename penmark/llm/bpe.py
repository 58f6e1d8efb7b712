"""BPE encoding and decoding through a table of distinct words.

Texts are split in Spark into the words that the tokenizer never merges across;
each distinct word is encoded once (once for every GROUP_BLOCKS blocks of
texts), and its ids come back to each text by the position of its words. A
text is decoded from its ids by a join with the vocabulary, which has a fixed
size and is therefore sent to all workers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.llm.blocks import BLOCK_BYTES, Chunks, lines_of, placed, unpacked
from penmark.llm.memory import give_back
from penmark.llm.session import table

#: Results of a task are handed on in batches of about this many tokens.
BATCH_TOKENS = 1_000_000
#: A row of the distinct-word table lists the blocks of one group, so its length is bounded.
GROUP_BLOCKS = 4096


def default_tokenizer() -> str:
    """Path of the public word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _tokenizer(text: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


class Splitter:
    """Splits a text as the tokenizer's normaliser and pre-tokenizer do.

    Texts without characters beyond U+017F are split by an equal pattern; all
    others by the library itself, whose tables of letters then hold. Special
    tokens are found in the raw text first and stand for themselves.
    """

    def __init__(self, tokenizer_json: str):
        self.library = _tokenizer(tokenizer_json)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        low = [chr(i) for i in range(0x180)]
        letter = "".join(c for c in low if c.isalpha())
        number = "".join(c for c in low if c.isnumeric())
        space = "\t\n\x0b\x0c\r \x85\xa0"
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
        self.beyond = re.compile("[^\x00-ſ]")

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond.search(text):
            return self.pattern.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _encoder(tokenizer_json: str):
    """A function from a word to its ids."""
    library = _tokenizer(tokenizer_json)
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    as_characters = byte_characters()

    def encode(word: str) -> list[int]:
        if word in special:
            return [special[word]]
        return [t.id for t in library.model.tokenize(word.encode().decode("latin-1").translate(as_characters))]

    return encode


def pieces_by_id(tokenizer_json: str) -> np.ndarray:
    """The piece of each id, special tokens included; null for ids that the vocabulary lacks."""
    vocabulary = _tokenizer(tokenizer_json).get_vocab(with_added_tokens=True)
    out = np.full(max(vocabulary.values()) + 1, None, dtype=object)
    out[list(vocabulary.values())] = list(vocabulary)
    return out


def pieces_table(spark: SparkSession, tokenizer_json: str) -> DataFrame:
    """(id, piece) of the whole vocabulary, special tokens included: a fixed number of rows."""
    vocabulary = _tokenizer(tokenizer_json).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pd.DataFrame({"id": list(vocabulary.values()), "piece": list(vocabulary)}), "id int, piece string")


def encode_texts(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    block_bytes: int = BLOCK_BYTES,
    with_ids: bool = False,
    with_decoded: bool = False,
) -> DataFrame:
    """Token ids of each text, without special tokens being added, and the text decoded from them.

    Returns a row for each row of `documents`: id_col, n_tokens (long),
    ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256,
    and on request ids (array of int) and decoded (string). A null text is an
    empty one, which has no tokens and decodes to an empty string. Special
    tokens that a text spells out get their ids, as in the library. Repeated
    rows and null ids are encoded like all others; further columns are not read.
    """
    spark = documents.sparkSession
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as file:
        tokenizer_json = file.read()
    sent = spark.sparkContext.broadcast(tokenizer_json)
    texts = placed(documents, id_col, text_col, block_bytes)
    kind = texts.schema["id"].dataType.simpleString()

    def distinct_words(rows: pa.Table) -> pa.Table:
        split = Splitter(sent.value)
        seen: set[str] = set()
        for text in unpacked(rows.column("text")):
            seen.update(split.words(text))
        block = rows.column("block")[0].as_py()
        out = pa.table({"word": pa.array(seen, pa.string()), "block": np.full(len(seen), block, dtype=np.int32)})
        give_back()
        return out

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunks = _encoder(sent.value), Chunks()
        for batch in batches:
            for word, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                line = " ".join([word, *map(str, encode(word))])
                for block in blocks:
                    yield from chunks.add(block, line)
        yield from chunks.rest()
        give_back()

    words = texts.groupBy("block").applyInArrow(distinct_words, "word string, block int")
    table_of_words = words.groupBy("word", F.floor(F.col("block") / GROUP_BLOCKS).alias("group")).agg(F.collect_set("block").alias("blocks"))
    known = table_of_words.select("word", "blocks").mapInArrow(encoded, Chunks.SCHEMA)

    def put_together(texts: pa.Table, chunks: pa.Table) -> Iterator[tuple]:
        ids: dict[str, bytes] = {}
        for line in lines_of(chunks):
            word, *rest = line.split(" ")
            ids[word] = np.array(rest, dtype="<u4").tobytes()
        split, pieces = Splitter(sent.value), pieces_by_id(sent.value)
        for key, text in zip(texts.column("id").to_pylist(), unpacked(texts.column("text")), strict=True):
            coded = b"".join([ids[w] for w in split.words(text)])
            yield key, coded, " ".join(pieces[np.frombuffer(coded, dtype="<u4")])

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_decoded]
    types = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_decoded

    def results(texts: pa.Table, chunks: pa.Table) -> pa.Table:
        key_type = texts.schema.field("id").type
        parts, rows, tokens = [], [], 0

        def flush() -> pa.Table:
            keys, coded, decoded = zip(*rows, strict=True)
            columns = [
                pa.array(keys, key_type),
                pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
            ]
            if with_ids:
                flat = np.frombuffer(b"".join(coded), dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32), flat))
            if with_decoded:
                columns.append(pa.array(decoded))
            return pa.Table.from_arrays(columns, names=names)

        for row in put_together(texts, chunks):
            rows.append(row)
            tokens += len(row[1]) // 4
            if tokens > BATCH_TOKENS:
                parts.append(flush())
                rows, tokens = [], 0
        if rows:
            parts.append(flush())
        del rows
        give_back()
        return pa.concat_tables(parts)

    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(results, types).withColumnRenamed("id", id_col)


def decode_ids(tokens: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """The text of each row's ids, by a join with the vocabulary: id_col, decoded.

    Special tokens are kept. Null or empty ids decode to an empty string; an id
    outside the vocabulary gives nothing. Repeated rows stay apart.
    """
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as file:
        pieces = pieces_table(tokens.sparkSession, file.read())
    numbered = tokens.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids")).withColumn("row", F.monotonically_increasing_id())
    return (
        numbered.select("row", "key", F.posexplode_outer("ids").alias("pos", "id"))
        .join(F.broadcast(pieces), "id", "left")
        .groupBy("row", "key")
        .agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("found"))
        .select(F.col("key").alias(id_col), F.array_join(F.transform("found", lambda x: x["piece"]), " ").alias("decoded"))
    )


def op2_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))
