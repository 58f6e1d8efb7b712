"""Cross-site boilerplate lines by HyperLogLog spread.

A sketch of the sites of each line hash merges by aggregation, map side first,
so that a line on a third of all pages costs each task one row. Lines whose
estimate is near the threshold get an exact distinct count; the others are
decided by the sketch, which is several standard errors away from it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.session import checkpointed, table

MIN_SITES = 10
LG_K = 12


def _margin(min_sites: int, lg_k: int) -> float:
    """Five standard errors of the sketch at the threshold, and one site at least."""
    return max(1.0, 5 * min_sites * 1.04 / math.sqrt(2**lg_k))


def boilerplate_lines(lines: DataFrame, min_sites: int, lg_k: int) -> DataFrame:
    """(h1, h2, first) of each line on `min_sites` sites or more; first: its earliest occurrence."""
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", lg_k).alias("sites"), F.min(F.struct("id", "row", "pos")).alias("first")
    )
    margin = _margin(min_sites, lg_k)
    rated = checkpointed(
        spread.select("h1", "h2", "first", F.hll_sketch_estimate("sites").alias("estimate")).where(F.col("estimate") >= min_sites - margin)
    )
    near = rated.where(F.col("estimate") <= min_sites + margin)
    exact = (
        lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2")
        .agg(F.countDistinct("site").alias("n_sites"))
        .where(F.col("n_sites") >= min_sites)
    )
    sure = rated.where(F.col("estimate") > min_sites + margin)
    return sure.select("h1", "h2", "first").unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", "first"))


def without_boilerplate(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
) -> DataFrame:
    """`documents` with n_lines, n_removed (long) and clean_text added.

    A line is what stands between newlines. Lines of white space only are never
    boilerplate. A boilerplate line stays where it occurs first (smallest id,
    then smallest position) and goes everywhere else, so no line vanishes from
    the corpus. A null site counts for no site. A null text stays null and has
    no lines; an empty text has one empty line. Rows that agree in id and text
    get the same result, each of them; a null id is the smallest. All columns of
    `documents` are kept; those named like an added column are replaced.
    """
    keyed = documents.withColumn("__row", F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)))
    each = keyed.select(
        F.col(id_col).alias("id"),
        F.col("__row").alias("row"),
        F.col(site_col).cast("string").alias("site"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"),
    ).where(F.col("line").rlike(r"\S"))
    lines = checkpointed(
        each.select("id", "row", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    )
    found = boilerplate_lines(lines, min_sites, lg_k)
    removed = (
        lines.join(found, ["h1", "h2"])
        .where(~F.struct("id", "row", "pos").eqNullSafe(F.col("first")))
        .groupBy("id", "row")
        .agg(F.collect_set("pos").alias("__removed"))
        .select(F.col("id").alias("__id"), F.col("row").alias("__row_of"), "__removed")
    )
    joined = keyed.join(removed, (F.col("__row") == F.col("__row_of")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    all_lines = F.split(F.col(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__removed"))
    clean = F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n")
    return (
        joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(all_lines)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("__removed"), F.lit(0)).cast("long"))
        .withColumn("clean_text", F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(clean))
        .drop("__row", "__id", "__row_of", "__removed")
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return without_boilerplate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"), "clean_text"
    )


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, pos, l[pos] AS line
  FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))),
wide AS (
  SELECT line, min(row(doc_id, pos)) AS first
  FROM lines WHERE regexp_matches(line, '\S') GROUP BY line HAVING count(DISTINCT source) >= 10),
judged AS (
  SELECT doc_id, pos, lines.line, wide.line IS NOT NULL AND row(doc_id, pos) <> first AS gone
  FROM lines LEFT JOIN wide ON lines.line = wide.line),
texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean_text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(clean_text) AS clean_sha256, clean_text
FROM documents d LEFT JOIN texts USING (doc_id)
"""
