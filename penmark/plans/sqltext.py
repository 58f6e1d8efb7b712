"""DuckDB expressions that define what the text functions give."""

from __future__ import annotations

from collections.abc import Sequence


def words(t: str = "text") -> str:
    """RE2 has an ASCII word boundary: runs of letters, digits and underscores are taken, then those of a-z kept."""
    return rf"list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+'))"


def cased(t: str = "text") -> str:
    return rf"list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+'))"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def tokens(t: str = "text") -> str:
    return rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')"


def sentences(t: str = "text") -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({t}, '[.!?]+'), lambda s: {strip('s')}), lambda s: s <> '')"


def terminated(t: str = "text") -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def paragraphs(t: str = "text") -> str:
    return rf"list_filter(list_transform(string_split({t}, chr(10) || chr(10)), lambda s: {strip('s')}), lambda s: s <> '')"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Sequence[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def among(items: str, values: Sequence[str]) -> str:
    return f"len(list_filter({items}, lambda x: list_contains({listed(values)}, x)))"


def present(text: str, phrases: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{p}') AS INTEGER)" for p in phrases) + ")"


def hits(text: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"len(regexp_extract_all({text}, '{quoted}'))"


def ngrams(w: str, n: int) -> str:
    return f"[array_to_string({w}[i + 1 : i + {n}], ' ') FOR i IN range(greatest(len({w}) - {n - 1}, 0))]"


def ratio(a: str, b: str, empty: str = "0") -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {empty})"


def r6(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"


#: (conv_id, text): turns of a conversation as paragraphs.
CONVERSATIONS = "(SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id)"
