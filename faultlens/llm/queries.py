"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
import importlib.util

MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_token_counts": "token_counts",
    "op3_substring_dedup": "substring_dedup",
    "op4_quality_rules": "quality_rules",
    "op5_mix_sources": "mixing",
    "op6_personal_data": "pii",
    "op7_language_id": "language_id",
    "op8_best_fit_packing": "packing",
    "op9_media_columns": "media",
    "op10_jaccard_join": "jaccard_join",
    "op11_lm_scores": "lm_scoring",
    "op12_filter_audit": "filter_audit",
    "op13_spelling_variants": "spelling",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES if importlib.util.find_spec(f'{__package__}.{MODULES[name]}')}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in queries() if (sql := getattr(_module(name), "SQL", None))}
