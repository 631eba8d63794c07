"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from importlib import import_module

#: query name -> module that holds a function of that name, and ORACLE where SQL can express it
MODULES = {
    "op8_fingerprints": "fingerprints",
    "op9_mixing": "mixing",
    "op10_language_id": "language_id",
    "pages_languages": "language_id",
    "op1_ngram_join": "ngram_join",
    "op2_quality": "quality",
    "op4_toxicity": "toxicity",
    "op7_token_counts": "token_counts",
    "op3_pii": "pii",
    "op5_decontamination": "decontamination",
    "op6_url_filters": "url_filters",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
