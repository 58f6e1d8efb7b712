"""Labelled corpora: descriptors, readers, label coercion and a cached sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.operators.metrics import coerced_label, sampled


@dataclass(frozen=True)
class Dataset:
    """Where a corpus is and which of its columns mean what."""

    name: str
    path: str = ""
    format: str = "parquet"
    text_field: str = "text"
    label_field: str = "label"
    label_map: Mapping[str, int] = field(default_factory=dict)
    meta_fields: Mapping[str, str] = field(default_factory=dict)


#: Fields and label maps of the public corpora.
DEFAULTS = (
    Dataset("raid", text_field="generation", label_field="model", label_map={"human": 0}, meta_fields={"domain": "domain", "source_id": "source_id"}),
    Dataset("mage", text_field="text", label_field="label", label_map={"human": 0, "machine": 1, "mixed": 2}),
    Dataset("hc3", text_field="text", label_field="label", label_map={"human": 0, "chatgpt": 1}),
    Dataset("m4", text_field="text", label_field="label", label_map={"human": 0, "machine": 1}),
)


class Datasets:
    """Descriptors by name, in order of their first registration; the last one of a name holds."""

    def __init__(self, known: Sequence[Dataset] = DEFAULTS):
        self._known = {d.name: d for d in known}

    def register(self, dataset: Dataset) -> None:
        self._known[dataset.name] = dataset

    def get(self, name: str) -> Dataset:
        if name not in self._known:
            raise ValueError(f"unknown dataset {name!r}; known are {', '.join(self._known)}")
        return self._known[name]

    def names(self) -> list[str]:
        return list(self._known)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(d.name, d.format, d.text_field, d.label_field, dict(d.label_map), dict(d.meta_fields)) for d in self._known.values()]
        return spark.createDataFrame(rows, "name string, format string, text_field string, label_field string, label_map map<string,int>, meta_fields map<string,string>")


def labelled(rows: DataFrame, dataset: Dataset) -> DataFrame:
    """(text, label, meta) without rows that lack text or label; meta has the fields that are present."""
    present = {out: own for out, own in dataset.meta_fields.items() if own in rows.columns}
    pairs = [x for out, own in present.items() for x in (F.lit(out), F.col(own).cast("string"))]
    meta = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    label, text = F.col(dataset.label_field).cast("string"), F.col(dataset.text_field)
    kept = rows.where(text.isNotNull() & (text != "") & label.isNotNull() & (label != ""))
    return kept.select(text.alias("text"), coerced_label(label, dict(dataset.label_map) or None).alias("label"), meta.alias("meta"))


def read(spark: SparkSession, dataset: Dataset) -> DataFrame:
    return labelled(spark.read.format(dataset.format).load(dataset.path), dataset)


def sample(spark: SparkSession, dataset: Dataset, limit: int, cache: str, seed: int = 42, refresh: bool = False) -> DataFrame:
    """A seeded sample of the corpus, kept as Parquet below `cache` and read from there the next time."""
    path = f"{cache}/{dataset.name}_{limit}_{seed}"
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass  # not sampled yet
    keyed = read(spark, dataset).withColumn("__key", F.xxhash64("text"))
    sampled(keyed, "__key", limit, seed).drop("__key").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) of a file with a JSON object on each line; a malformed line is an error."""
    return spark.read.schema("text string, label int").option("mode", "FAILFAST").json(path)


def tagged(rows: DataFrame, order_col: str, tags: Sequence[str], each: int = 100) -> DataFrame:
    """Column `language`: the tags in turn over the first each * len(tags) rows of the order, then `unknown`.

    Only as many rows as are tagged are numbered.
    """
    many = each * len(tags)
    first = rows.select(order_col).orderBy(order_col).limit(many).select(F.col(order_col).alias("__key"), (F.row_number().over(_by(order_col)) - 1).alias("__i"))
    listed = F.array(*map(F.lit, tags))
    joined = rows.join(F.broadcast(first), rows[order_col] == F.col("__key"), "left")
    return joined.withColumn("language", F.coalesce(F.get(listed, F.pmod(F.col("__i"), F.lit(len(tags)))), F.lit("unknown"))).drop("__key", "__i")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def previous_results(spark: SparkSession, path: str) -> DataFrame:
    """A row for each result of a suite report."""
    return spark.read.option("multiLine", True).json(path).select("name", "created_at", F.explode("results").alias("r")).select("name", "created_at", "r.*")


def promotion_summary(spark: SparkSession, path: str) -> DataFrame:
    """(detector, before, after) of a calibration summary."""
    metrics = "struct<auroc:double,f1:double,tpr_at_1fpr:double>"
    schema = f"dataset string, results map<string,struct<before:{metrics},after:{metrics}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.explode("results").alias("detector", "m")).select("detector", "m.before", "m.after")
