"""Queries over texts: projections, counts and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.functions import features as X
from penmark.functions import lexicons as L
from penmark.functions import text as T
from penmark.operators import detectors, grains, sentences
from penmark.operators.language_profiles import Profiles
from penmark.plans import sqltext as S


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang"), "doc_id")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """`rows` over all cores where their files have fewer row groups than there are cores; a large table is left as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def rounded(columns: dict[str, Column]) -> list[Column]:
    return [F.round(c.cast("double"), 6).alias(name) for name, c in columns.items()]


def _on_words(columns) -> callable:
    """A query of features that need the words and the text of each document."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = documents(spark, folder).select("doc_id", "text", "lang", T.words(F.col("text")).alias("w")).withColumn("k", T.run_lengths(F.col("w")))
        return rows.select("doc_id", *rounded(columns()))

    return query


def normalize_text(spark, folder):
    text = T.normalized(F.col("text"))
    return documents(spark, folder).select("doc_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))


def word_count_gate(spark, folder):
    n = F.size(T.tokens(F.col("text"))).cast("bigint")
    return documents(spark, folder).select("doc_id", n.alias("n_words"), (n < T.MIN_WORDS).alias("short"))


def chunk_documents(spark, folder):
    chunks = grains.chunked(documents(spark, folder))
    return chunks.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("start_char").cast("bigint").alias("start_char"), F.col("end_char").cast("bigint").alias("end_char"), F.md5("text").alias("digest"))


def tokenize_words(spark, folder):
    w = T.words(F.col("text"))
    return documents(spark, folder).select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.md5(F.array_join(w, " ")).alias("digest"))


def vocabulary_size(spark, folder):
    return documents(spark, folder).select("doc_id", F.size(F.array_distinct(T.words(F.col("text")))).cast("bigint").alias("vocabulary_size"))


def _split(splitter):
    def query(spark, folder):
        s = splitter(F.col("text"))
        return documents(spark, folder).select("doc_id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))

    return query


def _split_sql(expression: str) -> str:
    return f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {expression} AS s FROM documents)"


def paragraph_stats(spark, folder):
    talks = grains.conversation_texts(table(spark, folder, "conversations"))
    f = X.paragraph_shape(F.col("text"))
    return talks.select("conv_id", f["paragraph_count"].alias("paragraph_count"), *rounded({k: f[k] for k in ("paragraph_length_cv", "structure_regularity")}))


def pattern_repetition(spark, folder):
    talks = grains.conversation_texts(table(spark, folder, "conversations"))
    return talks.select("conv_id", *rounded({"pattern_repetition": X.paragraph_shape(F.col("text"))["pattern_repetition"]}))


_PARAGRAPHS = f"""SELECT conv_id, p, [CAST(len({S.tokens('x')}) AS DOUBLE) FOR x IN p] AS n FROM (SELECT conv_id, {S.paragraphs()} AS p FROM {S.CONVERSATIONS})"""


def abbreviations(spark, folder):
    found = sentences.abbreviations(sentences.type_counts(documents(spark, folder)).persist())  # read more than once
    return found.select("type", "n_with", "n_without", *rounded({"score": F.col("score")}))


def guarded_sentences(spark, folder):
    rows = documents(spark, folder)
    found = sentences.guarded_sentences(rows, sentences.type_counts(rows).persist())
    return found.select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), F.md5(F.array_join("sentences", "\n")).alias("digest"))


def language_profile(spark, folder):
    rows = documents(spark, folder)
    return Profiles.learn(rows).identify(rows).select("doc_id", "language", "n_trigrams", *rounded({"margin": F.col("margin")}))


def kl_divergence(spark, folder):
    docs = documents(spark, folder)
    reference = grains.reference_frequencies(docs.where("lang = 'en'"))
    return grains.kl_divergence(docs, reference).select("doc_id", *rounded({"kl_divergence": F.col("kl_divergence")}))


KL_SQL = f"""
WITH w AS (SELECT doc_id, lang, unnest({S.words()}) AS word FROM documents),
q AS (SELECT word, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS q FROM w WHERE lang = 'en' GROUP BY word),
c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word),
t AS (SELECT doc_id, n / CAST(sum(n) OVER (PARTITION BY doc_id) AS DOUBLE) AS p, coalesce(q, 1e-10) AS q FROM c LEFT JOIN q USING (word))
SELECT doc_id, round(coalesce(kl, 0), 6) AS kl_divergence
FROM documents LEFT JOIN (SELECT doc_id, sum(p * log2(p / q)) AS kl FROM t GROUP BY doc_id) USING (doc_id)"""


def repeated_ngrams(spark, folder):
    return grains.repeated_ngrams(documents(spark, folder))


def self_bleu(spark, folder):
    talks = grains.conversation_texts(table(spark, folder, "conversations"))
    return grains.self_bleu(talks, "conv_id").select("conv_id", *rounded({"self_bleu": F.col("self_bleu")}))


def readability(spark, folder):
    rows = documents(spark, folder).select("doc_id", "text", T.cased_words(F.col("text")).alias("c"))
    return rows.select("doc_id", *rounded(X.readability(F.col("text"), F.col("c")) | X.word_lengths(F.col("c"))))


def academic_features(spark, folder):
    rows = documents(spark, folder).select("doc_id", "text", T.cased_words(F.col("text")).alias("c"))
    return rows.select("doc_id", *rounded(X.citations(F.col("text")) | X.academic_language(F.col("text"), F.col("c"))))


def code_features(spark, folder):
    return table(spark, folder, "pages").select("page_id", *rounded(X.code(F.col("html"))))


def code_syntax(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.col("html").alias("text"))
    return detectors.syntax_features(pages, "page_id")


def multilingual_features(spark, folder):
    f = X.multilingual(F.col("text"), F.col("lang"))
    family = f.pop("language_family")
    return documents(spark, folder).select("doc_id", family.alias("language_family"), *rounded(f))


def rule_language(spark, folder):
    return documents(spark, folder).select("doc_id", X.language(F.col("text")).alias("language"))


_families = ", ".join(f"('{k}', '{v}', CAST({L.FAMILY_THRESHOLDS[v]} AS DOUBLE))" for k, v in L.LANGUAGE_FAMILIES.items())
MULTILINGUAL_BASE = rf"""
f(code, family, threshold) AS (VALUES {_families}),
m AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w,
    [CAST(len({S.tokens('s')}) AS DOUBLE) FOR s IN {S.sentences()}] AS n,
    [CAST(len({S.tokens('s')}) AS DOUBLE) FOR s IN list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: length(s) > 10 AND {S.strip('s')} <> '')] AS b, lang
  FROM documents),
pairs AS (SELECT doc_id, count(DISTINCT p) / CAST(count(*) AS DOUBLE) AS diversity FROM (SELECT doc_id, unnest([w[i] || w[i + 1] FOR i IN range(1, len(w))]) AS p FROM m) GROUP BY doc_id),
multi AS (
  SELECT m.doc_id, text, coalesce(family, 'other') AS language_family, coalesce(threshold, 0.35) AS family_threshold,
    CASE WHEN len(b) < 2 THEN coalesce(threshold, 0.35) ELSE coalesce(list_stddev_pop(b) / nullif(list_avg(b), 0), 0) END AS burstiness_cv,
    coalesce(diversity, 0) AS char_bigram_diversity, coalesce(list_avg([length(x) FOR x IN w]), 0) AS avg_word_length,
    coalesce(list_var_pop([CAST(length(x) AS DOUBLE) FOR x IN w]), 0) AS word_length_variance, coalesce(list_var_pop(n), 0) AS sentence_length_variance
  FROM m LEFT JOIN f ON code = lang LEFT JOIN pairs USING (doc_id))"""
_MULTI_COLUMNS = ("family_threshold", "burstiness_cv", "char_bigram_diversity", "avg_word_length", "word_length_variance", "sentence_length_variance")

_WORDS = f"(SELECT doc_id, text, {S.words()} AS w FROM documents)"
_COUNTS = f"(SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest({S.words()}) AS word FROM documents) GROUP BY doc_id, word)"
RICHNESS_SQL = f"""
SELECT doc_id, round(coalesce(ttr, 0), 6) AS ttr, round(coalesce(yules_k, 0), 6) AS yules_k, round(coalesce(herdans_c, 0), 6) AS herdans_c, round(coalesce(hapax_ratio, 0), 6) AS hapax_ratio
FROM documents LEFT JOIN (
  SELECT doc_id, count(*) / CAST(sum(k) AS DOUBLE) AS ttr, 10000.0 * CAST(sum(k * k) - sum(k) AS DOUBLE) / CAST(sum(k) * sum(k) AS DOUBLE) AS yules_k,
    CASE WHEN sum(k) > 1 THEN (count(*) - 1) / CAST(sum(k) AS DOUBLE) ELSE 0 END AS herdans_c, count(*) FILTER (k = 1) / CAST(sum(k) AS DOUBLE) AS hapax_ratio
  FROM {_COUNTS} GROUP BY doc_id) USING (doc_id)"""
ENTROPY_SQL = f"""
SELECT doc_id, round(coalesce(e, 0), 6) AS unigram_entropy, CAST(coalesce(v, 0) AS DOUBLE) AS vocabulary_size
FROM documents LEFT JOIN (SELECT doc_id, log2(CAST(sum(k) AS DOUBLE)) - sum(k * log2(CAST(k AS DOUBLE))) / sum(k) AS e, count(*) AS v FROM {_COUNTS} GROUP BY doc_id) USING (doc_id)"""
REPETITION_COLUMNS = ", ".join(S.r6(f"CASE WHEN len(g{n}) > 0 THEN 1 - len(list_distinct(g{n})) / CAST(len(g{n}) AS DOUBLE) ELSE 0 END", f"ngram_{n}_repetition") for n in (3, 4))
REPETITION_ROWS = f"(SELECT doc_id, w, {S.ngrams('w', 3)} AS g3, {S.ngrams('w', 4)} AS g4 FROM {_WORDS})"
_STYLE = {"transition_phrase_freq": S.present("lower(text)", L.TRANSITION_PHRASES), "function_word_ratio": S.among("w", L.FUNCTION_WORDS)} | {
    f"function_word_{x}_ratio": S.among("w", (x,)) if x in L.FUNCTION_WORDS else "0" for x in L.COUNTED_FUNCTION_WORDS
}
_PUNCTUATION = {f"punctuation_{k}_ratio": S.hits("text", p) for k, p in L.PUNCTUATION.items()} | {"quote_density": S.hits("text", '"[^"]*"'), "parenthetical_density": S.hits("text", L.PUNCTUATION["parenthetical"])}
_SENTENCE_SIZES = f"[CAST(len({S.tokens('s')}) AS DOUBLE) FOR s IN {S.sentences()}]"
TRANSITION_ROWS = f"(SELECT doc_id, [CAST({S.present('s', L.SENTENCE_TRANSITIONS)} AS DOUBLE) FOR s IN {S.sentences('lower(text)')}] AS t FROM documents)"
CITES = "list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}')" for p in L.CITATIONS) + ")"
CITATION_COLUMNS = {
    "citations_found": "len(c)",
    "citation_format_score": f"CASE WHEN len(c) > 0 THEN len(list_filter(c, lambda x: NOT regexp_matches(x, '{L.SUSPICIOUS_CITATION}'))) / CAST(len(c) AS DOUBLE) ELSE 0.5 END",
    "potential_hallucinations": f"CASE WHEN len(c) > 0 THEN len(list_filter(c, lambda x: regexp_matches(x, '{L.SUSPICIOUS_CITATION}'))) / CAST(len(c) AS DOUBLE) ELSE 0 END",
}
_LATIN = " + ".join(S.hits("text", f"(?i){p}") for p in L.LATIN_ABBREVIATIONS)
_ACADEMIC = CITATION_COLUMNS | {
    "avg_word_length": "coalesce(list_avg([length(x) FOR x IN w]), 0)", "latin_abbreviation_ratio": S.ratio(f"({_LATIN})", "len(w)"),
    "passive_ratio": S.ratio(S.hits("text", rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:was|were|been|being)\s+[a-z0-9_]+ed(?:[^\p{{L}}\p{{N}}_]|$)"), "len(w)"),
}
CLAIM_COLUMNS = {"hedging_ratio": S.ratio(S.among("d", L.HEDGING_WORDS), "len(d)"), "certainty_ratio": S.ratio(S.among("d", L.CERTAINTY_WORDS), "len(d)")}
_CODE = {
    "low_entropy_variable_ratio": S.ratio(f"len(list_filter(v, lambda x: list_contains({S.listed(L.VAGUE_NAMES)}, lower(x))))", "len(v)"),
    "comment_to_code_ratio": S.ratio("len(list_filter(n, lambda x: x[1] = '#' OR x[1:2] = '//'))", "len(n) - len(list_filter(n, lambda x: x[1] = '#' OR x[1:2] = '//'))"),
    "logical_complexity": S.ratio(f"len(list_filter(u, lambda x: list_contains({S.listed(L.BRANCHING_KEYWORDS)}, x)))", "len(n)"),
}


def _columns(named: dict[str, str], divisor: str | None = None) -> str:
    return ", ".join(S.r6(f"{e} / CAST({divisor} AS DOUBLE)" if divisor else e, name) for name, e in named.items())


def _matches(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {S.quoted(pattern)})"


def _core_sql(token: str) -> str:
    return f"regexp_replace(regexp_replace({token}, {S.quoted(sentences._OPENING)}, ''), {S.quoted(sentences._CLOSING)}, '')"


def _type_sql(core: str) -> str:
    return f"lower(CASE WHEN {_period_sql(core)} THEN left({core}, length({core}) - 1) ELSE {core} END)"


def _period_sql(core: str) -> str:
    return f"(ends_with({core}, '.') AND NOT ends_with({core}, '..'))"


_LIKELY = "hits * ln({0}) + CASE WHEN misses > 0 THEN misses * ln(1 - {0}) ELSE 0 END"
SENTENCES_SQL = f"""
tt AS (SELECT doc_id, {S.tokens()} AS t FROM documents),
tk AS (SELECT doc_id, i, len(t) AS n, t[i + 1] AS token, t[i] AS before, t[i + 2] AS after, {_core_sql('t[i + 1]')} AS core, {_core_sql('t[i + 2]')} AS next FROM (SELECT *, unnest(range(len(t))) AS i FROM tt)),
tc AS (SELECT {_type_sql('core')} AS type, count(*) FILTER ({_period_sql('core')}) AS n_with, count(*) FILTER (NOT {_period_sql('core')}) AS n_without, count(*) FILTER ({_matches('core', r'^\p{Ll}')}) AS n_lower,
    count(*) FILTER ({_matches('core', r'^\p{Lu}')} AND i > 0 AND NOT {_matches('before', sentences._END)}) AS n_inside, count(*) FILTER ({_matches('core', r'^\p{Lu}')} AND (i = 0 OR {_matches('before', sentences._SURE_END)})) AS n_starts
  FROM tk WHERE {_matches('core', sentences._WORD)} AND NOT ends_with(core, '..') GROUP BY 1),
ts AS (SELECT *, type.length() - inside AS letters FROM (SELECT type, n_with AS hits, n_without::DOUBLE AS misses, n_without, length(type) - length(replace(type, '.', '')) AS inside FROM tc WHERE n_with > 0)),
ab AS (SELECT * FROM (SELECT type, hits AS n_with, n_without, 2 * ({_LIKELY.format(f'{sentences.ABBREVIATED}::DOUBLE')} - ({_LIKELY.format('p')})) * exp(-letters::DOUBLE) * (inside + 1) * pow(letters::DOUBLE, -misses) AS score
  FROM ts, (SELECT sum(n_with) / sum(n_with + n_without)::DOUBLE AS p FROM tc)) WHERE score >= {sentences.LEAST_SCORE})"""

QUERIES = {
    "abbreviations": (abbreviations, f"WITH {SENTENCES_SQL} SELECT type, n_with, n_without, round(score, 6) AS score FROM ab"),
    "guarded_sentences": (guarded_sentences, f"""
WITH {SENTENCES_SQL},
held AS (SELECT doc_id, i FROM tk WHERE i < n - 1 AND {_period_sql('core')} AND {_matches('core', sentences._WORD)} AND {_type_sql('core')} IN (SELECT type FROM ab)
  AND NOT ({_matches('next', r'^\p{Lu}')} AND {_type_sql('next')} IN (SELECT type FROM tc WHERE n_lower > 0 AND n_inside = 0 AND n_starts > 0))),
ends AS (SELECT tk.*, (i = n - 1 OR {_matches('token', sentences._END)} AND NOT ({_matches('core', sentences._NUMBER)} AND {_matches('after', r'^\p{Ll}')}) AND held.i IS NULL)::INT AS last FROM tk LEFT JOIN held USING (doc_id, i)),
own AS (SELECT doc_id, s, string_agg(token, ' ' ORDER BY i) AS sentence FROM (SELECT *, sum(last) OVER (PARTITION BY doc_id ORDER BY i) - last AS s FROM ends) GROUP BY doc_id, s),
texts AS (SELECT doc_id, count(*) AS n, string_agg(sentence, chr(10) ORDER BY s) AS text FROM own GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_sentences, md5(coalesce(texts.text, '')) AS digest FROM documents LEFT JOIN texts USING (doc_id)"""),
    "language_profile": (language_profile, r"""
WITH g AS (SELECT doc_id, lang, w[i:i + 2] AS gram FROM (SELECT doc_id, lang, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, lang, ' ' || unnest(regexp_extract_all(lower(text), '\p{L}+')) || ' ' AS w FROM documents))),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY lang, gram),
b AS (SELECT lang, -ln(sum(n) + (SELECT count(DISTINCT gram) FROM c)::DOUBLE) AS base FROM c GROUP BY lang),
s AS (SELECT doc_id, b.lang, sum(ln(coalesce(c.n, 0) + 1.0::DOUBLE)) + count(*) * max(base) AS score, count(*) AS n FROM g CROSS JOIN b LEFT JOIN c ON c.lang = b.lang AND c.gram = g.gram GROUP BY doc_id, b.lang),
r AS (SELECT doc_id, lang, n, row_number() OVER o AS rank, (score - coalesce(lead(score) OVER o, score)) / n AS margin FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, lang))
SELECT doc_id, coalesce(r.lang, 'unknown') AS language, coalesce(n, 0) AS n_trigrams, round(margin, 6) AS margin FROM documents LEFT JOIN (SELECT * FROM r WHERE rank = 1) r USING (doc_id)"""),
    "normalize_text": (normalize_text, rf"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {S.strip(r"regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')")} AS t FROM documents)"),
    "word_count_gate": (word_count_gate, f"SELECT doc_id, CAST(len({S.tokens()}) AS BIGINT) AS n_words, len({S.tokens()}) < 150 AS short FROM documents"),
    "chunk_documents": (chunk_documents, """
WITH l AS (SELECT doc_id, text, length(text) AS l, CASE WHEN length(text) <= 512 THEN 1 ELSE 1 + CAST(ceil((length(text) - 512) / 384.0) AS BIGINT) END AS k FROM documents),
c AS (SELECT doc_id, text, l, unnest(range(k)) AS i FROM l),
s AS (SELECT doc_id, text, l, i, least(i * 384, greatest(0, l - 512)) AS a FROM c)
SELECT doc_id, i AS chunk_index, a AS start_char, a + least(l, 512) AS end_char, md5(substring(text, a + 1, 512)) AS digest FROM s WHERE l <= 50 OR least(l, 512) >= 50"""),
    "tokenize_words": (tokenize_words, f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM {_WORDS}"),
    "vocabulary_size": (vocabulary_size, f"SELECT doc_id, CAST(len(list_distinct(w)) AS BIGINT) AS vocabulary_size FROM {_WORDS}"),
    "sentence_split_regex": (_split(T.sentences), _split_sql(S.sentences())),
    "sentence_split_rule": (_split(T.terminated_sentences), _split_sql(S.terminated())),
    "sentence_length_stats": (_on_words(lambda: X.sentence_lengths(F.col("text"))), f"""
SELECT doc_id, round(coalesce(list_avg(n), 0), 6) AS avg_sentence_length, round(coalesce(list_stddev_samp(n), 0), 6) AS std_sentence_length,
  coalesce(list_max(n), 0) AS max_sentence_length, coalesce(list_min(n), 0) AS min_sentence_length FROM (SELECT doc_id, {_SENTENCE_SIZES} AS n FROM documents)"""),
    "paragraph_stats": (paragraph_stats, f"""
SELECT conv_id, CAST(CASE WHEN len(p) >= 2 THEN len(p) ELSE 0 END AS BIGINT) AS paragraph_count, round(CASE WHEN len(p) >= 2 THEN list_stddev_samp(n) / list_avg(n) ELSE 0 END, 6) AS paragraph_length_cv,
  round(CASE WHEN len(p) >= 2 THEN 1 - least(1, list_stddev_samp(n) / list_avg(n)) ELSE 0 END, 6) AS structure_regularity FROM ({_PARAGRAPHS})"""),
    "pattern_repetition": (pattern_repetition, f"""
WITH p AS ({_PARAGRAPHS}), f AS (SELECT conv_id, lower({S.tokens('x')}[1]) AS first FROM (SELECT conv_id, unnest(p) AS x FROM p)),
c AS (SELECT conv_id, first, count(*) AS k FROM f GROUP BY ALL), m AS (SELECT conv_id, max(k) / CAST(sum(k) AS DOUBLE) AS r, sum(k) AS size FROM c GROUP BY conv_id)
SELECT conv_id, round(CASE WHEN size >= 2 THEN r ELSE 0 END, 6) AS pattern_repetition FROM p LEFT JOIN m USING (conv_id)"""),
    "unigram_entropy": (_on_words(lambda: X.entropy(F.col("w"), F.col("k"))), ENTROPY_SQL),
    "kl_divergence": (kl_divergence, KL_SQL),
    "ngram_repetition": (_on_words(lambda: X.repetition(F.col("w"))), f"SELECT doc_id, {REPETITION_COLUMNS}, CAST(len(w) AS DOUBLE) AS word_count FROM {REPETITION_ROWS}"),
    "repeated_ngrams": (repeated_ngrams, f"""
WITH g AS (SELECT doc_id, 3 AS n, len(g3) AS total, unnest(g3) AS ngram FROM {REPETITION_ROWS} UNION ALL SELECT doc_id, 4, len(g4), unnest(g4) FROM {REPETITION_ROWS}),
c AS (SELECT doc_id, n, ngram, total, count(*) AS count FROM g GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count / CAST(total AS DOUBLE) DESC, n, ngram) AS rank FROM c)
SELECT doc_id, rank, CAST(n AS BIGINT) AS n, ngram, count FROM r WHERE rank <= 5"""),
    "self_bleu": (self_bleu, None),
    "lexical_richness": (_on_words(lambda: X.richness(F.col("w"), F.col("k"))), RICHNESS_SQL),
    "stylistic_ratios": (_on_words(lambda: X.style(F.col("text"), F.col("w"))), f"SELECT doc_id, {_columns(_STYLE, 'greatest(len(w), 1)')} FROM {_WORDS}"),
    "punctuation_ratios": (_on_words(lambda: X.punctuation(F.col("text"), F.col("w"))), f"SELECT doc_id, {_columns(_PUNCTUATION, 'greatest(len(w), 1)')} FROM {_WORDS}"),
    "syntax_constants": (_on_words(X.syntax), "SELECT doc_id, " + ", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in X.SYNTAX) + " FROM documents"),
    "readability": (readability, f"""
WITH r AS (SELECT doc_id, c, greatest(len({S.sentences()}), 1) AS s, [greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')), 1) FOR x IN c] AS y FROM (SELECT doc_id, text, {S.cased()} AS c FROM documents)),
v AS (SELECT doc_id, c, len(c) AS n, len(c) / CAST(s AS DOUBLE) AS per, {S.ratio('list_sum(y)', 'len(c)')} AS syl, {S.ratio('len(list_filter(y, lambda k: k >= 3))', 'len(c)')} AS hard FROM r)
SELECT doc_id, round(CASE WHEN n > 0 THEN 0.39 * per + 11.8 * syl - 15.59 ELSE 0 END, 6) AS flesch_kincaid_grade, round(CASE WHEN n > 0 THEN 0.4 * (per + 100 * hard) ELSE 0 END, 6) AS gunning_fog,
  round(CASE WHEN n > 0 THEN 206.835 - 1.015 * per - 84.6 * syl ELSE 0 END, 6) AS flesch_reading_ease, round(coalesce(list_avg([length(x) FOR x IN c]), 0), 6) AS avg_word_length,
  round(coalesce(list_stddev_samp([CAST(length(x) AS DOUBLE) FOR x IN c]), 0), 6) AS std_word_length FROM v"""),
    "transition_patterns": (_on_words(lambda: X.transitions(F.col("text"))), f"SELECT doc_id, round(coalesce(list_avg(t), 0), 6) AS transition_density, {S.r6(S.ratio('len(list_filter(t, lambda x: x > 0))', 'len(t)'), 'transition_uniformity')} FROM {TRANSITION_ROWS}"),
    "vocabulary_markers": (_on_words(lambda: X.vocabulary_markers(F.col("w"))), f"SELECT doc_id, {S.r6(S.ratio(S.among('w', L.ADVANCED_WORDS), 'len(w)'), 'advanced_word_ratio')} FROM {_WORDS}"),
    "argument_flow": (_on_words(lambda: X.argument_flow(F.col("text"))), f"SELECT doc_id, CAST(CASE WHEN len({S.terminated()}) >= 2 THEN 1 ELSE 0 END AS DOUBLE) AS clause_complexity, CAST(0 AS DOUBLE) AS sentence_depth_cv FROM documents"),
    "academic_features": (academic_features, f"SELECT doc_id, {_columns(_ACADEMIC)} FROM (SELECT doc_id, text, {CITES} AS c, {S.cased()} AS w FROM documents)"),
    "claim_language": (_on_words(lambda: X.claims(F.col("w"))), f"SELECT doc_id, {_columns(CLAIM_COLUMNS)} FROM (SELECT doc_id, list_distinct(w) AS d FROM {_WORDS})"),
    "code_features_regex": (code_features, rf"""
SELECT page_id, {_columns(_CODE)} FROM (
  SELECT page_id, list_distinct(list_filter(regexp_extract_all(html, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z_][a-zA-Z0-9_]*'))) AS v, regexp_extract_all(html, '[\p{{L}}\p{{N}}_]+') AS u,
    list_filter(list_transform(string_split(html, chr(10)), lambda s: {S.strip('s')}), lambda s: s <> '') AS n FROM pages)"""),
    "code_ast": (code_syntax, None),
    "multilingual_features": (multilingual_features, f"WITH {MULTILINGUAL_BASE} SELECT doc_id, language_family, {', '.join(S.r6(c, c) for c in _MULTI_COLUMNS)} FROM multi"),
    "language_id": (rule_language, rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}]+') AS w FROM documents),
v AS (SELECT doc_id, {', '.join(f"{S.among('w', x)} AS {k}" for k, x in L.STOP_WORDS.items())} FROM w)
SELECT doc_id, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'unknown' {' '.join(f"WHEN {k} = greatest(en, de, fr, es) THEN '{k}'" for k in L.STOP_WORDS)} END AS language FROM v"""),
}
