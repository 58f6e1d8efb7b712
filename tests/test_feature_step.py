"""The features that calibration and boosting learn from: the same values as the expressions, made once for all passes."""

from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.functions import text as T
from penmark.plans import evaluation

TEXTS = [
    (1, "One two three one two three one two three. Four! five"), (2, "a"), (3, "a b c"), (4, ""), (5, None), (6, "Ünder 12 x_y. Der die das; der die das der die."), (7, "a a a a a a a a"), (8, "a b c d. a b c d? a b c e"),
]


def test_words_told_apart_in_numpy_as_by_expressions(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("w", T.words(F.col("text"))).withColumn("k", T.run_lengths(F.col("w")))
    f = X.repetition(F.col("w")) | X.richness(F.col("w"), F.col("k"))
    for r in rows.select("doc_id", X.told_apart(F.col("w")).alias("d"), *[f[c].alias(c) for c in X.DISTINCT]).collect():
        assert [r["d"][c] for c in X.DISTINCT] == [r[c] for c in X.DISTINCT], r["doc_id"]


def test_texts_are_read_once_for_all_passes(spark, tmp_path):
    spark.createDataFrame([(i, t, "en") for i, t in TEXTS], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = evaluation._features(spark, str(tmp_path))
    assert {r["doc_id"]: r["label"] for r in rows.collect()} == {i: i % 2 if i < 6 else None for i in range(1, 9)}
    passes = rows.where("label IS NOT NULL"), rows.select("doc_id", "ttr")
    assert all("InMemoryRelation" in p._jdf.queryExecution().optimizedPlan().toString() for p in passes)
