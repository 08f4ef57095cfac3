"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name to the module that holds its `query(spark, sf_dir)`.
MODULES = {
    "op1_scoring": "scoring",
    "op2_bpe": "bpe",
    "op3_pii": "pii",
    "op4_packing": "packing",
    "op5_token_counts": "token_counts",
    "op6_neighbours": "neighbours",
    "op7_html": "html_extract",
    "op8_quality": "quality",
    "op9_language": "language_id",
    "op10_near_dup": "near_dup",
}


def queries() -> dict:
    return {name: importlib.import_module(f"ridgeline.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        if sql := getattr(importlib.import_module(f"ridgeline.llm.{module}"), "ORACLE_SQL", None):
            found[name] = sql
    return found
