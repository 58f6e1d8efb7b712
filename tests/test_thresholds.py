"""Scores at thresholds: deviations that are exact ones, and texts of odd white space."""

import statistics

import duckdb
from pyspark.sql import functions as F

from penmark.functions import text as T
from penmark.plans import scoring


def test_deviation_at_a_threshold_is_that_of_sql(spark, tmp_path):
    """Their deviation is 3 but for rounding; a sum of squares gives 3, SQL a little less."""
    sizes = [[6, 13, 9, 7, 4, 8, 5, 4, 4], [14, 15, 13, 11, 9, 8, 15, 16, 16], [6, 6, 9, 12, 12, 7, 3, 10, 7], [1, 4, 7]]
    rows = [(i, " ".join(" ".join(f"{chr(97 + k % 26)}{chr(97 + j)}" for k in range(n)) + "." for j, n in enumerate(own)), "en") for i, own in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    query, sql = scoring.QUERIES["detector_stylometric"]
    wanted = sorted(duck.execute(sql).fetchall())
    assert {score for _, score, _ in wanted} == {0.7, 0.3}
    assert sorted(map(tuple, query(spark, str(tmp_path)).select("doc_id", "score", "confidence").collect())) == wanted


def test_deviation_of_large_values_keeps_its_digits(spark):
    values = [1e9 + x for x in (4.0, 7.0, 13.0, 16.0)]
    (row,) = spark.createDataFrame([(values,)], "v array<double>").select(T.variance(F.col("v"), sample=True), T.mean(F.col("v"))).collect()
    assert tuple(row) == (statistics.variance(values), 1e9 + 10)
