"""Small Spark helpers of the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the tables that checkpointed() has written and discard() has not deleted.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = Path(tempfile.mkdtemp(prefix="penmark-checkpoint-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm_path


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written as a table below the shared checkpoint folder and read again.

    Cuts the lineage, so that a lost executor costs no recomputation, and takes
    less disk than rows do. The folder is that of spark.checkpoint.dir; only
    where a local session has none (tests) one of this machine is set. The
    table is deleted by discard(), else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/penmark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, jvm_path = _file_system(spark, path)
    files.deleteOnExit(jvm_path)
    stored = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[stored] = path
    return stored


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of checkpointed() that nothing will read any more; others are left alone."""
    for stored in tables:
        path = _FOLDERS.pop(stored, None) if stored is not None else None
        if path:
            files, jvm_path = _file_system(stored.sparkSession, path)
            files.delete(jvm_path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text modulo `divisor`; -1 for a null key, which is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % divisor, F.lit(-1))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def total_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column, to size partitions."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
