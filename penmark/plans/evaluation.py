"""Queries over labelled scores: metrics, strata, audits, samples, calibration, promotion, reports, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.functions import text as T
from penmark.operators import boosting, calibration, detectors, external, metrics, shapley
from penmark.plans import lexical as Q
from penmark.plans import sqltext as S
from penmark.plans.lexical import documents, rounded, table
from penmark.sources.datasets import Datasets
from penmark.sources.reports import pivoted
from penmark.streaming.monitor import drift

FEATURES = ("ngram_3_repetition", "ngram_4_repetition", "ttr", "hapax_ratio", "avg_sentence_length", "std_sentence_length")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, label, lang, n_words, score): labelled documents scored by their repeated three-word sequences."""
    rows = documents(spark, folder).select("doc_id", "lang", F.size(T.tokens(F.col("text"))).alias("n_words"), T.words(F.col("text")).alias("w"))
    score = F.round(X.repetition(F.col("w"))["ngram_3_repetition"], 6)
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return rows.select("doc_id", "lang", "n_words", score.alias("score")).join(labels, "doc_id")


SCORED_SQL = f"""scored AS (
  SELECT doc_id, quality AS label, lang, len({S.tokens()}) AS n_words, round(CASE WHEN len(g3) > 0 THEN 1 - len(list_distinct(g3)) / CAST(len(g3) AS DOUBLE) ELSE 0 END, 6) AS score
  FROM (SELECT doc_id, text, lang FROM documents) JOIN {Q.REPETITION_ROWS} USING (doc_id) JOIN labels USING (doc_id))"""


def _curve_sql(group: str = "1") -> str:
    return f"""points AS (SELECT {group} AS g, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY 1, 2),
curve AS (SELECT g, score, p, n, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY g) AS all_p, sum(n) OVER (PARTITION BY g) AS all_n, row_number() OVER d AS i FROM points WINDOW d AS (PARTITION BY g ORDER BY score DESC))"""


THRESHOLD = 0.02


def _curve_query(make, *names: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = make(metrics.curve(scored(spark, folder)))
        return found.select(*rounded({n: F.col(n) for n in names}))

    return query


def confusion_metrics(spark, folder):
    found = metrics.confusion(scored(spark, folder), threshold=THRESHOLD)
    return found.select("tn", "fp", "fn", "tp", *rounded({c: F.col(c) for c in ("accuracy", "precision", "recall", "f1")}))


def metric_bundle(spark, folder):
    found = metrics.bundle(scored(spark, folder), ["lang"], THRESHOLD)
    return found.select("lang", "num_samples", "num_positives", *rounded({c: F.col(c) for c in ("auroc", "average_precision", "fpr_at_10tpr", "tpr_at_5fpr", "f1")}))


def stratified_metrics(spark, folder):
    found = metrics.stratified(scored(spark, folder).withColumn("domain", F.col("lang")), ["domain"], threshold=THRESHOLD)
    return found.select("stratum", F.col("num_samples").alias("n"), *rounded({"auroc": F.col("auroc"), "f1": F.col("f1")}))


def metrics_by_language(spark, folder):
    """Each language and the short texts as strata, all metrics."""
    found = metrics.stratified(scored(spark, folder).withColumn("domain", F.col("lang")), ["domain"], by_value=True, threshold=THRESHOLD)
    return found.select("stratum", "num_samples", "num_positives", "tn", "fp", "fn", "tp", *rounded({c: F.col(c) for c in ("auroc", "fpr_at_10tpr", "tpr_at_5fpr", "f1")}))


def fpr_audit(spark, folder):
    rows = scored(spark, folder).withColumn("speakers", F.when(F.col("lang") == "en", "native").otherwise("non-native"))
    return metrics.fpr_by_group(rows, "speakers", THRESHOLD).select("speakers", "n", *rounded({"fpr": F.col("fpr")}))


def label_coercion(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    mapped = metrics.coerced_label(F.col("lang"), {"en": 0, "de": 2})
    return rows.select("doc_id", mapped.cast("bigint").alias("label"), metrics.coerced_label((F.col("doc_id") % 7).cast("string"), None).cast("bigint").alias("number"))


def sample_limit(spark, folder):
    return metrics.sampled(table(spark, folder, "events").select("event_id"), "event_id", 100)


def stratified_split(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return metrics.split(rows, "doc_id").select("doc_id", "label", "split")


def _features(spark, folder) -> DataFrame:
    """Features and labels of all documents, kept once made: fits, folds and predictions read numbers, not texts."""
    lengths = lambda s: F.struct(*[v.alias(c) for c, v in X.sentence_lengths(F.col("text"), s).items() if c in FEATURES])
    rows = documents(spark, folder).select("doc_id", X.told_apart(T.words(F.col("text"))).alias("d"), T.bind(X.sentence_sizes(F.col("text")), lengths).alias("s"))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    made = [F.col(f"{'d' if c in X.DISTINCT else 's'}.{c}") for c in FEATURES]
    return rows.select("doc_id", *made).persist().join(labels, "doc_id", "left")


def calibration_fit(spark, folder):
    rows = _features(spark, folder)
    fitted = calibration.fit(rows.where("label IS NOT NULL"), FEATURES, cv=3)
    return fitted.predict(rows).select("doc_id", *rounded({"score": F.col("score"), "confidence": F.col("confidence")}))


def boosted_stylometry(spark, folder):
    rows = _features(spark, folder)
    model = boosting.train(rows.where("label IS NOT NULL"), FEATURES, depths=(3,), rounds=5, folds=2)
    return boosting.predict(model, rows, FEATURES).select("doc_id", *rounded({"score": F.col("score"), "confidence": F.col("confidence")}))


def boosted_attributions(spark, folder):
    rows = _features(spark, folder)
    model = boosting.train(rows.where("label IS NOT NULL"), FEATURES, depths=(3,), rounds=5, folds=2)
    return boosting.attributions(model, rows, FEATURES, top=3)


def stylometric_attributions(spark, folder):
    """Shapley values of the stylometric rule's score, over all documents."""
    rows = documents(spark, folder).select("doc_id", "text", T.words(F.col("text")).alias("w")).withColumn("k", T.run_lengths(F.col("w")))
    f = X.richness(F.col("w"), F.col("k")) | X.sentence_lengths(F.col("text"))
    made = rows.select("doc_id", *[f[c].alias(c) for c in detectors.STYLOMETRIC_FEATURES])
    found = shapley.explain([detectors.STYLOMETRIC_TREE], made, detectors.STYLOMETRIC_FEATURES)
    values = {c: F.get("values", F.lit(i)) for i, c in enumerate(detectors.STYLOMETRIC_FEATURES)}
    return found.select("doc_id", *rounded({"expected": F.col("expected"), "margin": F.col("margin")} | values))


def promotion_gate(spark, folder):
    """Each language is gated as if it were a detector: scores against their squares' complements."""
    rows = scored(spark, folder)
    after = rows.withColumn("score", F.round(1 - F.col("score"), 6))

    def measured(of: DataFrame, name: str) -> DataFrame:
        one = metrics.auroc(metrics.curve(of, ["lang"]), ["lang"]).join(metrics.confusion(of, ["lang"], THRESHOLD).select("lang", "f1"), "lang")
        return one.select(F.col("lang").alias("detector"), F.struct(F.round("auroc", 6).alias("auroc"), F.round("f1", 6).alias("f1"), F.lit(None).cast("double").alias("tpr_at_1fpr")).alias(name))

    gated = calibration.promotion_reasons(measured(rows, "before").join(measured(after, "after"), "detector"))
    return gated.select("detector", "promoted", F.size("reasons").cast("bigint").alias("n_reasons"))


def dataset_catalog(spark, folder):
    return Datasets().table(spark).select("name", "text_field", "label_field")


def results_pivot_csv(spark, folder):
    rows = stratified_metrics(spark, folder).select(F.lit("repetition").alias("detector"), F.lit("documents").alias("dataset"), "stratum", "auroc", "f1")
    return pivoted(rows, ["domain", "short_texts"]).drop("auroc", "f1")


def classifier_mapping(spark, folder):
    """Conversation turns as if their roles were a classifier's labels."""
    p = F.pmod(F.length("text"), F.lit(101)) / 100.0
    score, confidence = external.classifier_score(F.col("role"), p)
    return table(spark, folder, "conversations").select("conv_id", "turn", *rounded({"score": score, "confidence": confidence}))


def reply_parsing(spark, folder):
    """Replies of a reasoning model, built from the events: JSON with text around it, sometimes broken."""
    n = F.col("event_id") % 4
    reply = F.concat(F.lit('Sure: {"score": 0.'), (F.col("event_id") % 9 + 1).cast("string"), F.lit(', "reasoning": "x", "confidence": "'), F.when(n == 1, "low").when(n == 2, "high").otherwise("sure"), F.when(n == 0, '"').otherwise('"}'), F.lit(" done"))
    parsed = external.json_reply(reply)
    return table(spark, folder, "events").select("event_id", F.round(parsed["score"], 6).alias("score"), parsed["confidence"].alias("confidence"))


def events_drift(spark, folder):
    found = drift(table(spark, folder, "events"), F.col("value"))
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))


_CONFUSION = "count(*) FILTER (label = 0 AND NOT guess) AS tn, count(*) FILTER (label = 0 AND guess) AS fp, count(*) FILTER (label = 1 AND NOT guess) AS fn, count(*) FILTER (label = 1 AND guess) AS tp"
_PR = f"{S.ratio('tp', '(tp + fp)')} AS precision, {S.ratio('tp', '(tp + fn)')} AS recall"
_F1 = S.ratio("2 * precision * recall", "(precision + recall)")
_AUROC = "CASE WHEN max(all_p) > 0 AND max(all_n) > 0 THEN CAST(sum(n * (tp - p) + n * p / 2.0) AS DOUBLE) / CAST(max(all_p) * max(all_n) AS DOUBLE) ELSE 0.5 END"
_CURVE = f"WITH {SCORED_SQL}, {_curve_sql()}"
_TPR, _FPR = "CAST(tp AS DOUBLE) / CAST(all_p AS DOUBLE)", "CAST(fp AS DOUBLE) / CAST(all_n AS DOUBLE)"
_HASH = "(({k} + 42) * 2654435761) % 1000003"


def _fpr_at(at: float, source: str, name: str) -> str:
    return f"""(SELECT g, CASE WHEN bool_and(two) THEN arg_max(CASE WHEN nt > t THEN f + ({at} - t) * (nf - f) / (nt - t) ELSE f END, i) ELSE 1 END AS {name} FROM (
      SELECT g, i, t, f, two, lead(t) OVER (PARTITION BY g ORDER BY i) AS nt, lead(f) OVER (PARTITION BY g ORDER BY i) AS nf FROM (
        SELECT g, i, {_TPR} AS t, {_FPR} AS f, all_p > 0 AND all_n > 0 AS two FROM {source} UNION ALL SELECT DISTINCT g, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), all_p > 0 AND all_n > 0 FROM {source})) WHERE t <= {at} GROUP BY g)"""


_STRATA_SQL = f"""{SCORED_SQL.replace('scored AS', 'base AS')}, each AS (
  SELECT *, 'domain' AS stratum FROM base WHERE lang IS NOT NULL UNION ALL SELECT *, 'short_texts' FROM base WHERE n_words < 150),
scored AS (SELECT * FROM each WHERE stratum IN (SELECT stratum FROM each GROUP BY stratum HAVING count(*) >= 10)), {_curve_sql('stratum')},
strata AS (SELECT stratum, n, round(auroc, 6) AS auroc, round({_F1}, 6) AS f1 FROM (SELECT *, {_PR} FROM (SELECT stratum, count(*) AS n, {_CONFUSION} FROM (SELECT *, score >= {THRESHOLD} AS guess FROM scored) GROUP BY stratum)) JOIN (SELECT g AS stratum, {_AUROC} AS auroc FROM curve GROUP BY g) USING (stratum))"""
_LANG = f"WITH {SCORED_SQL}, {_curve_sql('lang')}"

#: The value of a set of known features is bilinear in what is known (0 or 1) and the background's shares.
def _known(bits: int) -> str:
    a, b, c = (f"(CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0 END)" if bits >> i & 1 else p for i, (x, p) in enumerate((("x0", "p0"), ("x1", "p1"), ("x2", "p2"))))
    return f"({a} * 0.7 + (1 - {a}) * ({b} * 0.6 + (1 - {b}) * ({c} * 0.55 + (1 - {c}) * 0.3)))"


def _value(i: int) -> str:
    j, k = (1 << x for x in range(3) if x != i)
    own = 1 << i
    terms = ((0, 2), (j, 1), (k, 1), (j | k, 2))
    return "(" + " + ".join(f"{weight} * (v{others | own} - v{others})" for others, weight in terms) + ") / 6"


_ATTRIBUTIONS_SQL = f"""
WITH f AS (SELECT doc_id, coalesce(list_stddev_samp({Q._SENTENCE_SIZES}), 0) < 3 AS x0, coalesce(ttr, 0) < 0.4 AS x1, coalesce(hapax, 0) < 0.2 AS x2 FROM documents LEFT JOIN (
  SELECT doc_id, count(*) / CAST(sum(k) AS DOUBLE) AS ttr, count(*) FILTER (k = 1) / CAST(sum(k) AS DOUBLE) AS hapax FROM {Q._COUNTS} GROUP BY doc_id) USING (doc_id)),
p AS (SELECT avg(x0::INT) AS p0, coalesce(avg(x1::INT) FILTER (NOT x0), 0.5) AS p1, coalesce(avg(x2::INT) FILTER (NOT x0 AND NOT x1), 0.5) AS p2 FROM f),
v AS (SELECT doc_id, {', '.join(f'{_known(bits)} AS v{bits}' for bits in range(8))} FROM f, p)
SELECT doc_id, round(v0, 6) AS expected, round(v7, 6) AS margin, {', '.join(f'round({_value(i)}, 6) + 0.0 AS {c}' for i, c in enumerate(detectors.STYLOMETRIC_FEATURES))} FROM v"""

QUERIES = {
    "confusion_metrics": (confusion_metrics, f"""
WITH {SCORED_SQL} SELECT tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1
FROM (SELECT *, {S.ratio('(tn + tp)', '(tn + fp + fn + tp)')} AS accuracy, {_PR} FROM (SELECT {_CONFUSION} FROM (SELECT *, score >= {THRESHOLD} AS guess FROM scored)))"""),
    "auroc": (_curve_query(metrics.auroc, "auroc"), f"{_CURVE} SELECT round({_AUROC}, 6) AS auroc FROM curve"),
    "average_precision": (_curve_query(metrics.average_precision, "average_precision"), f"{_CURVE} SELECT round(sum(CAST(p AS DOUBLE) / CAST(all_p AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)), 6) AS average_precision FROM curve"),
    "auprc_trapezoid": (_curve_query(metrics.auprc_trapezoid, "auprc"), f"""{_CURVE}, e AS (SELECT i, {_TPR} AS r, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS p FROM curve UNION ALL SELECT 0, 0, 1 UNION ALL SELECT 2147483647, 1, 0)
SELECT round(sum(a), 6) AS auprc FROM (SELECT (r - lag(r) OVER (ORDER BY i)) * (p + lag(p) OVER (ORDER BY i)) / 2 AS a FROM e)"""),
    "tpr_at_fpr": (_curve_query(lambda c: metrics.tpr_at_fpr(c, 0.05, name="tpr_at_5fpr"), "tpr_at_5fpr"), f"{_CURVE} SELECT round(coalesce(max({_TPR}) FILTER ({_FPR} <= 0.05), 0), 6) AS tpr_at_5fpr FROM curve"),
    "fpr_at_tpr": (_curve_query(lambda c: metrics.fpr_at_tpr(c, 0.9, name="fpr_at_10tpr"), "fpr_at_10tpr"), f"{_CURVE} SELECT round(fpr_at_10tpr, 6) AS fpr_at_10tpr FROM {_fpr_at(0.9, 'curve', 'fpr_at_10tpr')}"),
    "metric_bundle": (metric_bundle, f"""{_LANG}
SELECT lang, num_samples, num_positives, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision, round(fpr_at_10tpr, 6) AS fpr_at_10tpr, round(t5, 6) AS tpr_at_5fpr, round({_F1}, 6) AS f1
FROM (SELECT *, {_PR} FROM (SELECT lang, count(*) AS num_samples, CAST(sum(label) AS BIGINT) AS num_positives, {_CONFUSION} FROM (SELECT *, score >= {THRESHOLD} AS guess FROM scored) GROUP BY lang))
JOIN (SELECT g AS lang, {_AUROC} AS auroc, sum(CAST(p AS DOUBLE) / CAST(all_p AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) AS ap, coalesce(max({_TPR}) FILTER ({_FPR} <= 0.05), 0) AS t5 FROM curve GROUP BY g) USING (lang)
JOIN (SELECT g AS lang, fpr_at_10tpr FROM {_fpr_at(0.9, 'curve', 'fpr_at_10tpr')}) USING (lang)"""),
    "stratified_metrics": (stratified_metrics, f"WITH {_STRATA_SQL} SELECT * FROM strata"),
    "metrics_by_language": (metrics_by_language, f"""
WITH {_STRATA_SQL.replace("'domain' AS stratum", "'domain=' || lang AS stratum")},
m AS (SELECT *, {_PR} FROM (SELECT stratum, count(*) AS num_samples, CAST(sum(label) AS BIGINT) AS num_positives, {_CONFUSION} FROM (SELECT *, score >= {THRESHOLD} AS guess FROM scored) GROUP BY stratum))
SELECT stratum, num_samples, num_positives, tn, fp, fn, tp, round(a, 6) AS auroc, round(fpr_at_10tpr, 6) AS fpr_at_10tpr, round(t5, 6) AS tpr_at_5fpr, round({_F1}, 6) AS f1
FROM m JOIN (SELECT g AS stratum, {_AUROC} AS a, coalesce(max({_TPR}) FILTER ({_FPR} <= 0.05), 0) AS t5 FROM curve GROUP BY g) USING (stratum) JOIN (SELECT g AS stratum, fpr_at_10tpr FROM {_fpr_at(0.9, 'curve', 'fpr_at_10tpr')}) USING (stratum)"""),
    "fpr_audit": (fpr_audit, f"""
WITH {SCORED_SQL} SELECT CASE WHEN lang = 'en' THEN 'native' ELSE 'non-native' END AS speakers, count(*) FILTER (label = 0) AS n, round({S.ratio(f'count(*) FILTER (label = 0 AND score >= {THRESHOLD})', 'count(*) FILTER (label = 0)')}, 6) AS fpr FROM scored GROUP BY 1"""),
    "label_coercion": (label_coercion, "SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 2 ELSE 1 END AS BIGINT) AS label, doc_id % 7 AS number FROM documents"),
    "sample_limit": (sample_limit, f"SELECT event_id FROM events ORDER BY {_HASH.format(k='event_id')}, event_id LIMIT 100"),
    "stratified_split": (stratified_split, f"""
WITH h AS (SELECT doc_id, quality AS label, {_HASH.format(k='doc_id')} AS o FROM labels), q AS (SELECT label, quantile_cont(CAST(o AS DOUBLE), 0.2) AS q FROM h GROUP BY label)
SELECT doc_id, label, CASE WHEN o < q THEN 'test' ELSE 'train' END AS split FROM h JOIN q USING (label)"""),
    "calibration_fit": (calibration_fit, None),
    "boosted_stylometry": (boosted_stylometry, None),
    "boosted_attributions": (boosted_attributions, None),
    "stylometric_attributions": (stylometric_attributions, _ATTRIBUTIONS_SQL),
    "promotion_gate": (promotion_gate, f"""
WITH {SCORED_SQL.replace('scored AS', 'base AS')}, scored AS (SELECT lang || '|0' AS lang, label, score FROM base UNION ALL SELECT lang || '|1', label, round(1 - score, 6) FROM base), {_curve_sql('lang')},
m AS (SELECT split_part(lang, '|', 1) AS detector, split_part(lang, '|', 2) AS step, round(auroc, 6) AS auroc, round({_F1}, 6) AS f1 FROM (SELECT *, {_PR} FROM (SELECT lang, {_CONFUSION} FROM (SELECT *, score >= {THRESHOLD} AS guess FROM scored) GROUP BY lang)) JOIN (SELECT g AS lang, {_AUROC} AS auroc FROM curve GROUP BY g) USING (lang)),
r AS (SELECT a.detector, CAST(b.auroc - a.auroc < 0.01 AS BIGINT) + CAST(a.f1 - b.f1 > 0 AS BIGINT) AS n_reasons FROM m a JOIN m b ON a.detector = b.detector AND a.step = '0' AND b.step = '1')
SELECT detector, n_reasons = 0 AS promoted, n_reasons FROM r"""),
    "dataset_catalog": (dataset_catalog, "SELECT * FROM (VALUES ('raid', 'generation', 'model'), ('mage', 'text', 'label'), ('hc3', 'text', 'label'), ('m4', 'text', 'label')) v(name, text_field, label_field)"),
    "results_pivot_csv": (results_pivot_csv, f"""
WITH {_STRATA_SQL} SELECT 'repetition' AS detector, 'documents' AS dataset, {', '.join(f"max({m}) FILTER (stratum = '{s}') AS strat_{s}_{m}" for s in ('domain', 'short_texts') for m in ('auroc', 'f1'))} FROM strata"""),
    "classifier_mapping": (classifier_mapping, """
SELECT conv_id, turn, round(CASE WHEN regexp_matches(lower(role), 'human|real') THEN 1 - p ELSE p END, 6) AS score, round(least(1, p + 0.1), 6) AS confidence FROM (SELECT conv_id, turn, role, CAST((length(text) % 101) / 100.0 AS DOUBLE) AS p FROM conversations)"""),
    "reply_parsing": (reply_parsing, """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE round(CAST(event_id % 9 + 1 AS DOUBLE) / 10, 6) END AS score, CAST(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM events"""),
    "events_drift": (events_drift, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2"),
}
