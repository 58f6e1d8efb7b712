"""From raw documents to token ids: language ID, line dedup, near-duplicate removal, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents,
the last one tokens. Stages are meant to be written and read again one by one;
run() cuts the lineage after each by a checkpoint. None can be expressed in
SQL together with the first, so ORACLE_SQL is None and tests check each stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.llm.bpe import encode_texts
from penmark.llm.decontaminate import contamination, cut_spans
from penmark.llm.jaccard_join import similar_documents
from penmark.llm.language_id import identify_language
from penmark.llm.line_dedup import without_boilerplate
from penmark.llm.session import checkpointed, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected if no learned language has this posterior probability.
MIN_POSTERIOR = 0.5


def _documents(docs: DataFrame, text: F.Column) -> DataFrame:
    """The columns of documents with a new text and its length."""
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; texts that are null or without letters go."""
    found = identify_language(docs, carry=COLUMNS[1:])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_POSTERIOR)).select(*COLUMNS)


def remove_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines repeated on many sites; one of which no line is left goes."""
    found = without_boilerplate(docs)
    return _documents(found.where((F.col("n_removed") == 0) | (F.trim("clean_text") != "")), F.col("clean_text"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; all that have no near-duplicate.

    Of several rows with that id the one of the least hash stays, of equal rows
    one. A null id is larger than all others. Texts without words are in no group.
    """
    # Rows get names of their own: ids may be null or repeated. Files keep the names when they are read again.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text", "lang", "source"), F.monotonically_increasing_id())
    numbered = checkpointed(docs.select(order.alias("row"), *COLUMNS))
    groups = checkpointed(similar_documents(numbered, id_col="row"))
    gone = groups.where("row <> component_id").select("row")
    return numbered.join(gone, "row", "left_anti").select(*COLUMNS)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with the benchmark; one of which no word is left goes."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    return _documents(found.where("n_hit = 0 OR n_hit < n_words"), cut_spans(F.col("text"), F.col("spans")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the text decoded from them."""
    return encode_texts(docs, with_ids=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", remove_boilerplate_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", remove_benchmark_passages),
    ("bpe_encoding", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
