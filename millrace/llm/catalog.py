"""Queries of the training-data operators."""

from __future__ import annotations

from importlib import import_module

#: Query name by module.
MODULES = {"lmscore": "op9_lm_scoring", "sitestyle": "op3_html_extraction", "jaccard": "op10_jaccard_join", "substring": "op6_substring_dedup", "tokenstore": "op5_token_store", "linededup": "op7_line_dedup", "packing": "op2_packing", "decontaminate": "op1_decontaminate", "quality": "op4_quality_rules", "licenses": "op8_license_scan", "alignment": "op12_tokenizer_alignment", "personal": "op13_personal_data", "negatives": "op11_hard_negatives"}

#: Further queries of a module: module, function, SQL.
MORE = {"op10_jaccard_links": ("jaccard", "links_query", "LINKS_SQL")}


def queries() -> dict:
    found = {name: import_module(f"millrace.llm.{m}").query for m, name in MODULES.items()}
    return found | {name: getattr(import_module(f"millrace.llm.{m}"), f) for name, (m, f, _) in MORE.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"millrace.llm.{m}"), "SQL", None) for m, name in MODULES.items()}
    found |= {name: getattr(import_module(f"millrace.llm.{m}"), sql) for name, (m, _, sql) in MORE.items() if sql}
    return {k: v for k, v in found.items() if v}
