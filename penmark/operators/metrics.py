"""Exact ranking and confusion metrics of scored, labelled rows.

Curves have a row for each distinct score, made by one aggregation; what
follows are window sums over that. Groups are columns, so many detectors,
datasets and strata are evaluated in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.functions import text as T

#: Slices of the scores from 0 to 1 in which curves are summed.
SLICES = 4096


def confusion(rows: DataFrame, groups: Sequence[str] = (), threshold: float = 0.5, *more: Column) -> DataFrame:
    """tn, fp, fn, tp and what follows from them, and `more` aggregates; zero denominators give 0. Labels other than 0 and 1 count nowhere."""
    guess = F.col("score") >= threshold
    counted = rows.groupBy(*groups).agg(
        F.count_if((F.col("label") == 0) & ~guess).alias("tn"), F.count_if((F.col("label") == 0) & guess).alias("fp"),
        F.count_if((F.col("label") == 1) & ~guess).alias("fn"), F.count_if((F.col("label") == 1) & guess).alias("tp"), *more,
    )
    return _judged(counted)


def _judged(counted: DataFrame) -> DataFrame:
    tp, precision, recall = F.col("tp"), F.col("precision"), F.col("recall")
    return (
        counted.withColumn("accuracy", T.ratio(F.col("tn") + tp, F.col("tn") + F.col("fp") + F.col("fn") + tp))
        .withColumn("precision", T.ratio(tp, tp + F.col("fp")))
        .withColumn("recall", T.ratio(tp, tp + F.col("fn")))
        .withColumn("f1", T.ratio(2 * precision * recall, precision + recall))
    )


def curve(rows: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """For each group and distinct score: p and n there, tp and fp down to it, all P and N, and i, counted from the highest score.

    Labels other than 0 and 1 count nowhere. NaN is the highest score, null the lowest.
    """
    return accumulated(rows.where(F.col("label").isin(0, 1)).groupBy(*groups, "score").agg(*_counts()), groups)


def _counts() -> tuple[Column, Column]:
    return F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")


def accumulated(points: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The curve of counted points (groups, score, p, n), one for each group and score.

    Sums run in two levels, so that no task holds a whole group: within slices
    of 1/SLICES of a score, and over the totals of the slices. Scores beyond
    0 to 1 make more slices.
    """
    points = points.withColumn("slice", F.when(F.isnan("score"), F.lit((1 << 63) - 1)).otherwise(F.floor(F.col("score") * SLICES)))
    whole = Window.partitionBy(*groups)
    above = whole.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    totals = points.groupBy(*groups, "slice").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.count("*").alias("points"))
    totals = totals.select(
        *[F.col(g).alias(f"of_{g}") for g in (*groups, "slice")], *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("p", "n", "points")],
        F.sum("p").over(whole).alias("all_p"), F.sum("n").over(whole).alias("all_n"),
    )
    down = Window.partitionBy(*groups, "slice").orderBy(F.desc("score"))
    running = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = points.select("*", F.sum("p").over(running).alias("tp"), F.sum("n").over(running).alias("fp"), F.row_number().over(down).alias("place"))
    joined = within.join(totals, reduce(and_, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in (*groups, "slice")]))
    return joined.select(
        *groups, "score", "p", "n", (F.col("tp") + F.col("p_above")).alias("tp"), (F.col("fp") + F.col("n_above")).alias("fp"),
        "all_p", "all_n", (F.col("place") + F.col("points_above")).alias("i"),
    )


def _both() -> Column:
    return (F.first("all_p") > 0) & (F.first("all_n") > 0)


def _auroc() -> Column:
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.col("n") * F.col("p") / 2)
    return F.when(_both(), T.ratio(area, F.first("all_p") * F.first("all_n"))).otherwise(0.5)


def _average_precision() -> Column:
    return F.sum(T.ratio(F.col("p"), F.col("all_p")) * T.ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def _auprc() -> Column:
    # The point before has tp - p and fp - n; before the first, precision is 1. The last has a recall of 1, or there are no positives.
    tp, before = F.col("tp"), F.col("tp") - F.col("p")
    precision, earlier = T.ratio(tp, tp + F.col("fp")), T.ratio(before, before + F.col("fp") - F.col("n"), 1.0)
    return F.sum(T.ratio(F.col("p"), F.col("all_p")) * (precision + earlier) / 2)


def _tpr_at(at: float) -> Column:
    ok = (F.col("all_n") > 0) & (T.ratio(F.col("fp"), F.col("all_n")) <= at)
    return F.coalesce(F.max(F.when(ok, T.ratio(F.col("tp"), F.col("all_p")))), F.lit(0.0))


def _fpr_at(at: float) -> Column:
    # The first point beyond `at`; the one before it has tp - p and fp - n.
    t, f = T.ratio(F.col("tp"), F.col("all_p")), T.ratio(F.col("fp"), F.col("all_n"))
    low, left = T.ratio(F.col("tp") - F.col("p"), F.col("all_p")), T.ratio(F.col("fp") - F.col("n"), F.col("all_n"))
    first = F.min(F.when(t > at, F.struct("i", low.alias("low"), left.alias("left"), t.alias("t"), f.alias("f"))))
    between = first["left"] + (at - first["low"]) * T.ratio(first["f"] - first["left"], first["t"] - first["low"])
    return F.when(_both(), F.coalesce(between, F.max(f))).otherwise(1.0)


def auroc(points: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with average ranks; a single class gives 0.5."""
    return points.groupBy(*groups).agg(_auroc().alias("auroc"))


def average_precision(points: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision; 0 without positives."""
    return points.groupBy(*groups).agg(_average_precision().alias("average_precision"))


def auprc_trapezoid(points: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Trapezoids under precision over recall, from (0, 1) to (1, 0)."""
    return points.groupBy(*groups).agg(_auprc().alias("auprc"))


def tpr_at_fpr(points: DataFrame, at: float, groups: Sequence[str] = (), name: str = "tpr") -> DataFrame:
    """The largest TPR whose FPR is `at` or less; 0 if there is none, or only one class."""
    return points.groupBy(*groups).agg(_tpr_at(at).alias(name))


def fpr_at_tpr(points: DataFrame, at: float, groups: Sequence[str] = (), name: str = "fpr") -> DataFrame:
    """The FPR at a TPR, linear between the last point whose TPR is `at` or less and the next; one class gives 1."""
    return points.groupBy(*groups).agg(_fpr_at(at).alias(name))


def _ranking() -> list[Column]:
    """fpr_at_10tpr is the FPR at a TPR of 0.9, fpr_at_20tpr that at 0.8."""
    return [
        _auroc().alias("auroc"), _average_precision().alias("average_precision"), _fpr_at(0.9).alias("fpr_at_10tpr"), _fpr_at(0.8).alias("fpr_at_20tpr"),
        _tpr_at(0.01).alias("tpr_at_1fpr"), _tpr_at(0.05).alias("tpr_at_5fpr"),
    ]


def bundle(rows: DataFrame, groups: Sequence[str] = (), threshold: float = 0.5, *more: Column) -> DataFrame:
    """All metrics of each group, and `more` aggregates, in one row: one aggregation over the curve, one over the rows."""
    counted = confusion(rows, groups, threshold, F.count("*").alias("num_samples"), F.sum("label").alias("num_positives"), *more)
    ranked, keys = curve(rows, groups).groupBy(*groups).agg(*_ranking()), list(groups)
    out = ranked.join(counted, keys) if keys else ranked.join(counted)
    return out.withColumn("num_negatives", F.col("num_samples") - F.col("num_positives"))


def stratified(rows: DataFrame, keys: Sequence[str], *, words_col: str = "n_words", least: int = 10, short: int = 150, by_value: bool = False, threshold: float = 0.5) -> DataFrame:
    """The metrics of bundle() for each stratum of strata(), by grouping sets: no row is copied.

    Each key is a column that names the row's stratum, or null; one aggregation
    over the sets (key, score) counts the points of all strata at once.
    """
    names = {f"__stratum{i}": c for i, c in enumerate(_strata_names(keys, words_col, short, by_value))}
    named = rows.withColumns(names)
    sets = [[F.col(c), F.col("score")] for c in names]
    counted = named.groupingSets(sets, *[F.col(c) for c in names], F.col("score")).agg(*_counts(), F.count("*").alias("rows"), F.sum("label").alias("labels"))
    points = counted.withColumn("stratum", F.coalesce(*[F.col(c) for c in names])).where("stratum IS NOT NULL").select("stratum", "score", "p", "n", "rows", "labels")
    at, p, n = F.col("score") >= threshold, F.col("p"), F.col("n")
    sums = points.groupBy("stratum").agg(
        F.sum("rows").alias("num_samples"), F.sum("labels").alias("num_positives"),
        *[F.sum(F.when(c, v).otherwise(0)).alias(a) for a, c, v in (("tn", ~at, n), ("fp", at, n), ("fn", ~at, p), ("tp", at, p))],
    ).where(F.col("num_samples") >= least)
    ranked = accumulated(points.where("p + n > 0").select("stratum", "score", "p", "n"), ["stratum"]).groupBy("stratum").agg(*_ranking())
    return ranked.join(_judged(sums), "stratum").withColumn("num_negatives", F.col("num_samples") - F.col("num_positives"))


def _strata_names(keys: Sequence[str], words_col: str, short: int, by_value: bool) -> list[Column]:
    names = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k).cast("string")) if by_value else F.lit(k)) for k in keys]
    return [*names, F.when(F.col(words_col) < short, F.lit("short_texts"))]


def strata(rows: DataFrame, keys: Sequence[str], words_col: str = "n_words", least: int = 10, short: int = 150, by_value: bool = False) -> DataFrame:
    """A row for each stratum that a row belongs to, with column stratum; strata of fewer than `least` rows are left out.

    A stratum is named by a key and holds the rows where that is not null;
    `short_texts` holds those of fewer than `short` words. By value, each value
    of a key is a stratum of its own.
    """
    names = _strata_names(keys, words_col, short, by_value)
    each = rows.withColumn("stratum", F.explode(F.array_compact(F.array(*names))))
    sizes = each.groupBy("stratum").agg(F.count("*").alias("size")).where(F.col("size") >= least).select("stratum")
    return each.join(F.broadcast(sizes), "stratum", "left_semi") if not by_value else each.join(sizes, "stratum", "left_semi")


def fpr_by_group(rows: DataFrame, group_col: str, threshold: float = 0.5) -> DataFrame:
    """(group, n, fpr): the share of label 0 that scores `threshold` or more; 0 for a group without any."""
    negative = F.col("label") == 0
    return rows.groupBy(group_col).agg(
        F.count_if(negative).alias("n"), T.ratio(F.count_if(negative & (F.col("score") >= threshold)), F.count_if(negative)).alias("fpr")
    )


def coerced_label(value: Column, mapping: dict[str, int] | None) -> Column:
    """An integer label from a string: by the mapping, 1 for what it lacks; without one, as a number."""
    if not mapping:
        return value.cast("int")
    out = F.lit(1)
    for name, number in mapping.items():
        out = F.when(value == name, number).otherwise(out)
    return F.when(value.isNotNull(), out)


def hash_order(key: Column, seed: int = 42) -> Column:
    """A seeded pseudo-random order of integer keys that other engines can reproduce."""
    return F.pmod((F.pmod(key.cast("long"), F.lit(1 << 31)) + seed) * F.lit(2654435761), F.lit(1_000_003))


def sampled(rows: DataFrame, key: str, limit: int, seed: int = 42) -> DataFrame:
    """`limit` rows without replacement, by seeded hash order."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(limit)


def split(rows: DataFrame, key: str, label_col: str = "label", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Column split, `train` or `test`: the first share of each class in seeded hash order is the test set.

    A percentile of the order is found by counting hash values per class, so
    no class is sorted in one task; equal hash values fall on one side.
    """
    ordered = rows.withColumn("__order", hash_order(F.col(key), seed))
    counts = ordered.groupBy(label_col, "__order").agg(F.count("*").alias("n"))
    limits = counts.groupBy(label_col).agg(F.percentile("__order", F.lit(test_share), F.col("n")).alias("__limit"))
    joined = ordered.join(F.broadcast(limits), label_col)  # a row for each class
    return joined.withColumn("split", F.when(F.col("__order") < F.col("__limit"), "test").otherwise("train")).drop("__order", "__limit")


def require_both_classes(rows: DataFrame, label_col: str = "label") -> None:
    if rows.where(F.col(label_col).isin(0, 1)).select(label_col).distinct().count() < 2:
        raise ValueError("both classes are needed")
