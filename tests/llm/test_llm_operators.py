"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from penmark.llm import bpe, components, ctw, decontaminate, fm_index, jaccard_join, language_id, line_dedup, lm_score, media, pii, quality, session, url_filter

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (1, "Is and retitioning ouen the of the and of", "en", "src0", 1), (1, "Is and retitioning ouen the of the and of", "en", "src0", 1),
    (2, None, None, None, None), (None, "le la un des et qui que pour dans", "fr", "src1", 3), (3, "", "de", "src2", 0), (4, " \n\t ", "en", "src3", 2),
    (5, "x" * 70_000, "en", None, 4), (6, "12 34 !!", None, "src4", 5), (7, "A\u0301 caf\u00e9 \u4e2d\u6587 \U0001f600 <|endoftext|> don't", "fr", "src5", 6),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with everything that may go wrong, and columns named like results and inner names."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("score", "n", "node", "block", "word", "row", "id", "pos", "held_out", "n_words", "spans"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return session.table(spark, FOLDER, "documents")


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_suffix_array_and_index_against_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 7, 300):
        text = rng.integers(1, 4, n)
        assert list(fm_index.suffix_array(text)) == sorted(range(n), key=lambda i: list(text[i:]))
        index = fm_index.FMIndex(text, 4)
        phrases = rng.integers(1, 4, (40, 4))
        phrases[:10, :2] = -1
        for p, low, high in zip(phrases, *index.search(phrases), strict=True):
            p = [x for x in p if x >= 0]
            assert sorted(index.locate(np.arange(low, high))) == [i for i in range(n - len(p) + 1) if list(text[i : i + len(p)]) == p]


@pytest.mark.parametrize("block_rows", [250_000, 3])
def test_decontamination(spark, odd, empty, block_rows):
    items = [(1, "retitioning OUEN the"), (2, "le la un des et qui que pour dans les rues"), (3, None), (None, "is and"), (4, ""), (10, "the"), (10, "the")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("phrase", F.lit(1))
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.contamination(odd, bench, block_rows=block_rows).collect()}
    first = got[(1, 9)]
    assert (first["n_hit"], first["items"], [(s["start"], s["end"]) for s in first["spans"]]) == (4, ["1", "10"], [(7, 27), (31, 34)])
    assert got[(2, 0)]["n_hit"] == 0 and got[(None, 9)]["n_hit"] == 0
    assert decontaminate.contamination(odd, bench).count() == len(ODD)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(odd, bench.limit(0)).collect())
    cut = decontaminate.contamination(odd, bench, carry=["text"]).where("n_hit > 0").select(decontaminate.cut_spans(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    assert cut == "Is and  of  and of"


def test_line_dedup_against_brute_force(spark, odd, empty):
    rows = [(i, f"shared line\nown {i}\nshared line", f"s{i % 12}") for i in range(30)] + [(99, "few\nfew", "s1"), (100, None, "s1"), (101, "", None), (102, "shared line", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup.without_boilerplate(df).collect()}
    assert got[0]["clean_text"] == "shared line\nown 0" and got[0]["n_removed"] == 1
    assert all(got[i]["clean_text"] == f"own {i}" for i in range(1, 30))
    assert got[99]["clean_text"] == "few\nfew" and got[100]["clean_text"] is None and got[101]["clean_text"] == "" and got[102]["clean_text"] == ""
    assert line_dedup.without_boilerplate(odd).count() == len(ODD) and line_dedup.without_boilerplate(empty).count() == 0
    exact = spark.createDataFrame([(i, "edge", f"s{i}") for i in range(9)], "doc_id bigint, text string, source string")
    assert line_dedup.without_boilerplate(exact).agg(F.sum("n_removed")).first()[0] == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    part[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("partners", "hot"), [((3, 8), 1 << 20), ((), 1 << 20), ((), 0), ((1,), 30)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, partners, hot):
    monkeypatch.setattr(jaccard_join, "PARTNERS", partners)
    rng = np.random.default_rng(len(partners) + hot)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(rng.choice(vocabulary, 12))
    for base in range(12):
        words = list(rng.choice(vocabulary, int(rng.integers(3, 60))))
        for _ in range(int(rng.integers(1, 9))):
            own = list(words)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(len(own)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(own) + (f" {passage}" if base % 3 == 0 else "")))
    rows += [(1000 + i, t) for i, t in enumerate(["", None, "one two", "One  two", "one two three", " "])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_documents(df, hot=hot).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_edges(odd, empty):
    got = jaccard_join.similar_documents(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] == 1} == {1}
    assert jaccard_join.similar_documents(empty).count() == 0


@pytest.mark.parametrize("text", ["one", "one two", "one two three", "one two three four"])
def test_jaccard_join_of_a_lone_short_text(spark, text):
    df = spark.createDataFrame([(7, text)], "doc_id bigint, text string").coalesce(1)
    assert [tuple(r) for r in jaccard_join.similar_documents(df).collect()] == [(7, 1, 7)]


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    part = {x: x for e in edges for x in e}
    for _ in range(len(part)):
        if not any([part.update({a: m, b: m}) or True for a, b in edges for m in [min(part[a], part[b])] if part[a] != part[b]]):
            break
    assert got == {x: c for x, c in part.items() if x in got} and all(part[x] == x for x in set(part) - set(got))
    assert components.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")).count() == 0


def test_bpe_against_the_library(spark, odd, empty, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    for df in (odd, documents):
        got = bpe.encode_texts(df, with_ids=True, with_decoded=True).collect()
        wanted = sorted(
            (library.encode(r["text"] or "", add_special_tokens=False).ids for r in df.select("text").collect()), key=lambda ids: (len(ids), ids)
        )
        assert sorted((list(r["ids"]) for r in got), key=lambda ids: (len(ids), ids)) == wanted
        for r in got:
            assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
            assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], dtype="<u4").tobytes()).hexdigest()
    assert bpe.encode_texts(empty).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(odd, with_ids=True))
    assert back.count() == len(ODD)


class LiteralTree:
    """Context-tree weighting over the decisions of a byte stream, as its definition reads."""

    def __init__(self, texts):
        self.stream = [x for t in texts for x in self.positions(t)]
        self.counts, self.tree = cache(self._counts), cache(self._tree)

    @staticmethod
    def positions(text):
        codes = [ctw.END] * ctw.DEPTH + list(lowered(text).encode()) + [ctw.END]
        return [(tuple(reversed(codes[i - ctw.DEPTH : i])), codes[i]) for i in range(ctw.DEPTH, len(codes))]

    def _counts(self, context, node):
        """Zeros and ones of a decision after a context."""
        level, prefix = node.bit_length() - 1, node - (1 << (node.bit_length() - 1))
        bits = [(c >> (ctw.BITS - 1 - level)) & 1 for k, c in self.stream if k[: len(context)] == context and c >> (ctw.BITS - level) == prefix]
        return bits.count(0), bits.count(1)

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, context, node):
        return sum(self.tree(k, node) for k in {k[: len(context) + 1] for k, _ in self.stream if k[: len(context)] == context})

    def _tree(self, context, node):
        a, b = self.counts(context, node)
        if not a + b:
            return 0.0
        return self.kt(a, b) if len(context) == ctw.DEPTH else np.logaddexp(self.kt(a, b), self.below(context, node)) - math.log(2)

    def one(self, path, node, depth=0, shorter=0.5):
        a, b = self.counts(path[:depth], node)
        own = (b + 0.5) / (a + b + 1) if a + b else shorter
        if depth == ctw.DEPTH:
            return own
        weight = 1 / (1 + math.exp(self.below(path[:depth], node) - self.kt(a, b)))
        return weight * own + (1 - weight) * self.one(path, node, depth + 1, own)

    def byte_log2(self, path, code):
        total, node = 0.0, 1
        for level in range(ctw.BITS):
            bit = code >> (ctw.BITS - 1 - level) & 1
            p = self.one(path, node)
            total += math.log2(p if bit else 1 - p)
            node = node * 2 + bit
        return total


@pytest.mark.parametrize("block_bytes", [40, 1_000_000])
def test_lm_scores_against_the_literal_recursion(spark, block_bytes):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("aB c"), 14))) for i in range(14)] + [(14, ""), (15, "caf\u00e9 \U0001f600")]
    got = {r["doc_id"]: r for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), block_bytes=block_bytes).collect()}
    tree = LiteralTree([t for i, t in rows if fold(i, 7) != 2])
    assert {r["held_out"] for r in got.values()} == {True, False}
    for i, t in rows:
        wanted = sum(tree.byte_log2(*x) for x in tree.positions(t))
        assert math.isclose(got[i]["score"], wanted * math.log10(2), rel_tol=1e-4)
        assert math.isclose(got[i]["bits_per_byte"], -wanted / (len(t.encode()) + 1), rel_tol=1e-4)
    path = tree.positions("ab c")[3][0]
    assert math.isclose(sum(2 ** tree.byte_log2(path, c) for c in range(256)), 1)


def test_lm_scores_base_against_brute_force(odd, empty, documents):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lowered(t or "")) + [None]
    rows = documents.select("doc_id", "text").collect()
    counts = {}
    for r in rows:
        for w in words(r["text"]) if fold(r["doc_id"], 7) != 2 else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm_score.lm_scores(documents).collect()}
    for r in rows:
        own, mine = words(r["text"]), got[r["doc_id"]]
        assert (mine["n_tokens"], mine["n_known"], mine["train_tokens"]) == (len(own), sum(w in counts for w in own), n)
        assert math.isclose(mine["base_score"], sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert mine["score"] < 0 and mine["held_out"] == (fold(r["doc_id"], 7) == 2)
    assert lm_score.lm_scores(odd).where("score IS NOT NULL AND NOT isnan(score)").count() == len(ODD)
    assert lm_score.lm_scores(empty).count() == 0


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def literal_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0
    keep = [
        lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")),
        lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15,
    ]
    return sorted((m.start(), k, m.end()) for k, p in enumerate((EMAIL, IP, CARD, PHONE)) for m in re.finditer(p, text) if keep[k](m[0]))


def test_base_spans_against_the_patterns():
    rng = np.random.default_rng(2)
    for alphabet in ("ab1@..+- ()45%_\u00e9\n", "12.+- ", "4 -0"):
        for _ in range(4000):
            text = "".join(rng.choice(list(alphabet), int(rng.integers(0, 45))))
            assert pii.base_spans(text) == literal_spans(text)
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 50_000, "+1" + "(" * 50_000, "*" * 200_000 + "1"):
        pii.examine(text)


def test_bootstrapping_finds_unseen_identifiers(spark, odd, empty):
    rows = [(i, f"please mail contact {'user%d@example.com' % i if i < 20 else 'member-%05d' % i} today") for i in range(24)] + [(90, "code zz-99-zz here"), (91, "again member-00022 alone")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.find_personal_data(df).collect()}
    assert got[22] == [(20, 4, 32)] and got[91] == [(6, 4, 18)] and got[90] == [] and got[3][0][1] == 0
    assert pii.find_personal_data(odd).count() == len(ODD) and pii.find_personal_data(empty).count() == 0


def test_bootstrapping_from_the_shape_of_keys(spark):
    keys = [hashlib.sha1(bytes([i])).hexdigest() for i in range(12)]
    rows = [(i, f'set token = "{k}" here') for i, k in enumerate(keys)] + [(20, 'set token = "blue42-short" here'), (21, f"the digest {keys[0][::-1]} of a file")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.find_personal_data(df).collect()}
    assert all(got[i] == [(13, 4, 53)] for i in range(12)) and got[20] == [(13, 4, 25)] and got[21] == []


def test_quality_held_out_accuracy(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    labels = session.table(spark, folder, "labels")
    got = quality.op1_quality_classifier(spark, folder).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    for given in (labels, labels.limit(0), spark.createDataFrame([(1, None), (1, 1), (1, 0)], "doc_id bigint, quality int")):
        scores = quality.quality_scores(odd, given)
        assert scores.where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert quality.quality_scores(empty, labels).count() == 0


def test_language_id_held_out_accuracy(spark, odd, empty):
    docs = session.table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify_language(docs, carry=("lang",)).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    out = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify_language(odd).collect()]
    assert len(out) == len(ODD) and {x for i, x in out if i in (2, 3, 4, 6)} == {"und"}
    assert language_id.identify_language(empty).count() == 0


def test_forward_sums_all_segmentations():
    vocabulary = language_id.Vocabulary(inner={"a": 0, "b": 1, "ab": 2}, final={"b": 3, "ab": 4, "bab": 5}, longest=3)
    p = np.array([[0.2], [0.3], [0.1], [0.05], [0.15], [0.2]])

    def literal(word):
        ends = p[vocabulary.final[word], 0] if word in vocabulary.final else 0.0
        return ends + sum(p[i, 0] * literal(word[len(x) :]) for x, i in vocabulary.inner.items() if word.startswith(x) and len(x) < len(word))

    words = ["b", "ab", "bab", "abab", "aab"]
    lattice = language_id.Lattice(words, vocabulary)
    assert np.allclose(lattice.total(p)[:, 0], [literal(w) for w in words])
    assert np.allclose(lattice.backward(p)[:, 0, 0], lattice.total(p)[:, 0])
    for i, w in enumerate(words):
        alone = language_id.Lattice([w], vocabulary)
        assert np.allclose(np.exp(alone.log_forward(np.log(p))[-1]), lattice.total(p)[i])
        assert np.allclose(alone.log_uses(np.log(p), 0), lattice.uses(p, np.zeros(len(words), dtype=int))[lattice.word == i])


def literal_uses(word, vocabulary, p):
    """Probability and expected uses of each piece, by listing all segmentations."""

    def segmentations(rest):
        if rest in vocabulary.final:
            yield [vocabulary.final[rest]]
        for x, i in vocabulary.inner.items():
            if rest.startswith(x) and len(x) < len(rest):
                for more in segmentations(rest[len(x) :]):
                    yield [i, *more]

    total, uses = 0.0, np.zeros(len(p))
    for own in segmentations(word):
        weight = np.prod(p[own, 0])
        total += weight
        np.add.at(uses, own, weight)
    return total, uses / total


@pytest.mark.parametrize("longest", [60, 0])
def test_language_model_training_against_all_segmentations(spark, monkeypatch, longest):
    monkeypatch.setattr(language_id, "LONGEST", longest)
    monkeypatch.setattr(language_id, "_LIFT", 1.0)
    vocabulary = language_id.Vocabulary(inner={"a": 0, "b": 1, "ab": 2}, final={"a": 3, "b": 4, "ab": 5, "bab": 6}, longest=3)
    p = np.array([[0.2], [0.3], [0.1], [0.05], [0.1], [0.05], [0.2]])
    words = [("b", 2), ("ab", 1), ("bab", 3), ("abab", 1), ("aabb", 2)]
    wanted = sum(n * literal_uses(w, vocabulary, p)[1] for w, n in words)
    counts = spark.createDataFrame([("xx", w, n) for w, n in words], "lang string, word string, n bigint")
    model = language_id.Model(["xx"], np.zeros(1), p, vocabulary)
    found = language_id._expected(counts, model)
    got = np.zeros(len(p))
    got[found["piece"]] = found["uses"]
    assert np.allclose(got, wanted)
    assert np.allclose(np.exp(model.word_scores([w for w, _ in words])[:, 0]), [literal_uses(w, vocabulary, p)[0] for w, _ in words])


def test_url_rules_and_aliases(spark):
    rows = [
        (1, "http://a.net/x", '<link rel="canonical" href="https://example.org/es/1">'), (2, "http://b.net/y", '<META HTTP-EQUIV=refresh content="0; url=http://a.net/x#f">'),
        (3, "http://c.net/", "<link href='/z' rel=canonical>"), (4, "http://c.net/z", None), (5, None, "x"), (6, "nourl", ""), (7, "http://d.net", '<link rel=canonical href="q.html">'),
        (8, "http://d.net/q.html", '<link rel=canonical href="//example.org/es/q"><meta http-equiv="refresh" content="5;url=https://sub.com/fr/">'),
        (12, "http://e.net/", "<link rel=canonical href='/none'><link rel=canonical href='http://a.net/x'>"), (9, "https://Sub.EXAMPLE.org/en/12?x", ""), (10, "https://notexample.org/es/1", ""), (10, "https://notexample.org/es/1", ""), (11, "x://y://org/es/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"], r["decided_by"]) for r in url_filter.judge_urls(df, url_filter.rule_table(spark)).collect()}
    assert got[1] == ("a.net", None, "block", "alias") and got[2][2:] == ("block", "alias") and got[3][2:] == ("allow", "default")
    assert got[12][2:] == ("block", "alias") and got[7][2:] == ("allow", "alias") and got[8][2:] == ("allow", "alias")
    assert got[9] == ("sub.example.org", "example.org/en/1", "block", "rule") and got[10] == ("notexample.org", "org/", "allow", "rule")
    assert got[5] == ("", None, "allow", "default") and got[6][0] == "" and got[11][0] == "y:"
    assert url_filter.judge_urls(df, url_filter.rule_table(spark)).count() == len(rows)
    assert url_filter.judge_urls(df.limit(0), url_filter.rule_table(spark)).count() == 0


def test_media_round_trip(odd, empty, documents):
    for df in (odd, documents):
        texts = sorted((r["text"] or "") for r in df.select("text").collect())
        read = media.read_media(media.store_texts(df)).collect()
        assert sorted(bytes(r["pixels"])[: r["n_bytes"]].decode() for r in read) == texts
        assert all(len(r["pixels"]) == max(64, -(-r["n_bytes"] // 64) * 64) and not any(r["pixels"][r["n_bytes"] :]) for r in read)
    assert media.read_media(media.store_texts(empty)).count() == 0


def test_wide_image_for_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "ab c" * 300_000)], "doc_id bigint, text string")
    r = media.read_media(media.store_texts(df)).first()
    assert bytes(r["pixels"])[: r["n_bytes"]] == b"ab c" * 300_000 and r["height"] <= 16384


def test_string_buffer_of_slices():
    column = pa.array(["ab", None, "", "cde"]).slice(1)
    raw, offsets = __import__("penmark.llm.textbytes", fromlist=["x"]).string_buffer(column)
    assert bytes(raw) == b"cde" and list(offsets) == [0, 0, 0, 3]
