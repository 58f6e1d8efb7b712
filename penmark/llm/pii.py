"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

One pass over the texts finds the spans of the fixed kinds and all other tokens
that look like identifiers, each with the words to its left and the character
to its right. The former are seeds, and so are tokens with the shape of keys
(long hexadecimal or mixed strings). Contexts ("patterns") and tokens
("instances") form a graph, which Spark scores in turns: a pattern is as
reliable as its instances are known, and an instance as its patterns are
reliable. Tokens whose patterns make them pass are reported as kind `id`; the
shape of a key alone does not suffice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.session import checkpointed, discard, table

KINDS = ("email", "ip", "card", "phone", "id")
#: Distinct instances that a reliable pattern has at least, and the share of known ones among them.
MIN_SUPPORT = 4
MIN_CONFIDENCE = 0.6
ACCEPT = 0.75

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Possessive runs: a failed match can't begin anew within the same run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_./+=@-])(?=[A-Za-z_./+=@-]*+[0-9])[A-Za-z0-9_./+=@-]{6,}+")
#: Shapes of keys: 32 or more hexadecimal digits, or 20 or more characters with both cases and digits.
_KEY = re.compile(r"(?=.*[0-9])(?:(?=.*[a-f])[0-9a-f]{32,}|(?=.*[A-F])[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_/+=-]{20,})")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ on, so that long runs cost linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed kinds, in order; code points, end exclusive."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return sorted(found)
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The one and the two words to the left, digits as 0, with the character to the right (a for a letter)."""
    left = _DIGIT.sub("0", text[max(0, start - 60) : start].lower())
    glued = left and not left[-1].isspace()
    words = left.split()
    right = text[end : end + 1]
    right = "a" if right.isalnum() else " " if right.isspace() else right
    mark = "" if glued else " "
    return [f"{' '.join(words[-n:])}{mark}<>{right}" for n in (1, 2) if len(words) >= n]


def examine(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and all identifier-like spans with their instance and patterns."""
    base = base_spans(text)
    spots = [{"start": s, "end": e, "instance": text[s:e].lower(), "seed": True, "base": True, "patterns": _patterns(text, s, e)} for s, _, e in base]
    if _DIGIT.search(text):
        taken, i = sorted((s, e) for s, _, e in base), 0
        for m in _TOKEN.finditer(text):
            s, e = m.span()
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if i == len(taken) or taken[i][0] >= e:
                spots.append({"start": s, "end": e, "instance": m[0].lower(), "seed": bool(_KEY.fullmatch(m[0])), "base": False, "patterns": _patterns(text, s, e)})
    return [{"start": s, "kind": k, "end": e} for s, k, e in base], spots


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_SPOT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("seed", pa.bool_()), ("base", pa.bool_()), ("patterns", pa.list_(pa.string()))])


def reliable_instances(edges: DataFrame, *, min_support: int, min_confidence: float, accept: float) -> DataFrame:
    """Instances that are not of the fixed kinds but whose patterns give them `accept` or more, from distinct edges (pattern, instance, seed, base).

    pattern: sum of its instances' scores / (number of instances + 1), if it has
    `min_support` instances and that value is `min_confidence` or more, else 0;
    instance: 1 - product of (1 - value) over its patterns; a seed counts as 1
    for its patterns. Values only rise, so reliable patterns and accepted
    instances only grow in number; it ends when a turn adds none of either.
    """
    scores = edges.where("seed").select("instance", F.lit(1.0).alias("score")).distinct()
    before, found = None, None
    while before is None or found != before:
        before, last = found, scores
        rated = (
            edges.join(scores, "instance", "left")
            .groupBy("pattern")
            .agg((F.sum(F.coalesce("score", F.lit(0.0))) / (F.count("*") + 1)).alias("confidence"), F.count("*").alias("support"))
            .where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
        )
        scores = checkpointed(
            edges.join(rated.select("pattern", "confidence"), "pattern", "left")
            .groupBy("instance")
            .agg(
                F.max("seed").alias("seed"), F.max("base").alias("base"), F.count("confidence").alias("patterns"),
                F.sum(F.log1p(-F.coalesce("confidence", F.lit(0.0)))).alias("doubt"),
            )
            .select("instance", "base", "patterns", (1 - F.exp("doubt")).alias("own"), F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("score"))
            .where("score > 0")
        )
        discard(last)
        found = tuple(scores.agg(F.count("*"), F.sum("patterns"), F.count_if(F.col("own") >= accept)).first())
    return scores.where(~F.col("base") & (F.col("own") >= accept)).select("instance")


def find_personal_data(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_support: int = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    accept: float = ACCEPT,
) -> DataFrame:
    """Spans of personal data of each text: id_col, base and spans, arrays of (start, kind, end).

    kind numbers KINDS; base has the fixed kinds, spans also those discovered;
    both are ordered by start, then kind. A null or empty text has none. Equal
    rows get equal results; null ids are fine. An instance is a token in lower
    case; once accepted, all its occurrences in the corpus are spans. Other
    columns are not read.
    """
    source = documents.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("row")
    )

    def examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [examine(t.as_py()) for t in batch.column(1)]
            base, spots = pa.array([b for b, _ in found], pa.list_(_SPAN)), pa.array([s for _, s in found], pa.list_(_SPOT))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), base, spots], names=["id", "row", "base", "spots"])

    kind = source.schema["id"].dataType.simpleString()
    spans = "array<struct<start:int,kind:int,end:int>>"
    spots = "array<struct<start:int,end:int,instance:string,seed:boolean,base:boolean,patterns:array<string>>>"
    texts = checkpointed(source.mapInArrow(examined, f"id {kind}, row bigint, base {spans}, spots {spots}"))
    each = texts.select("row", F.explode("spots").alias("spot")).select("row", "spot.*")
    edges = checkpointed(
        each.select(F.explode("patterns").alias("pattern"), "instance", "seed", "base")
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed"), F.max("base").alias("base"))
    )
    accepted = reliable_instances(edges, min_support=min_support, min_confidence=min_confidence, accept=accept)
    new = (
        each.where(~F.col("base"))
        .join(accepted, "instance")
        .groupBy("row")
        .agg(F.collect_set(F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")).alias("new"))
    )
    together = F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(spans))))
    return texts.join(new, "row", "left").select(F.col("id").alias(id_col), "base", together.alias("spans"))


def span_list(spans: F.Column) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def number(kind: int) -> F.Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[number(i).alias(f"n_{KINDS[i]}") for i in range(4)], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans")
    )
