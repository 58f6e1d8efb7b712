"""Operators of a training-data pipeline, and their registered queries."""

from __future__ import annotations

from importlib import import_module

#: module: (query, name of its DuckDB SQL or None where SQL cannot express it)
_REGISTERED = {
    "jaccard_join": ("op3_ngram_jaccard_join", "OP3_SQL"),
    "url_filter": ("op7_url_filters", "OP7_SQL"),
    "lm_score": ("op4_lm_scoring", None),
    "pii": ("op5_pii", None),
    "quality": ("op1_quality_classifier", None),
    "bpe": ("op2_bpe_encoding", None),
    "language_id": ("op10_language_id", None),
    "line_dedup": ("op6_line_dedup", "OP6_SQL"),
    "media": ("op8_media_columns", None),
    "decontaminate": ("op9_benchmark_decontamination", "OP9_SQL"),
    "periodic_runs": ("op11_periodic_run_detection", "OP11_SQL"),
    "prefix_trie": ("op12_conversation_prefix_trie", "OP12_SQL"),
    "token_counts": ("op13_token_counts", None),
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for module, (name, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__name__}.{module}"), sql) for module, (name, sql) in _REGISTERED.items() if sql}
