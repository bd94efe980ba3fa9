"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib

#: module: query
OPERATORS = {
    "op1_warc": "op1_warc",
    "op2_fingerprints": "op2_fingerprints",
    "op3_quality": "op3_quality",
    "op4_repeated_phrases": "op4_repeated_phrases",
    "op5_mixing": "op5_mixing",
    "op6_top_k": "op6_top_k",
    "op7_pii": "op7_pii",
    "op8_packing": "op8_packing",
    "op9_token_counts": "op9_token_counts",
    "op10_jaccard_join": "op10_jaccard_join",
    "op11_line_runs": "op11_line_runs",
    "op12_token_alignment": "op12_token_alignment",
    "op13_periodic_runs": "op13_periodic_runs",
}


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"tessera.llm.{module}"), name) for module, name in OPERATORS.items()}
    return found | {"op2_near_duplicates": importlib.import_module("tessera.llm.op2_fingerprints").op2_near_duplicates, "pipeline": importlib.import_module("tessera.llm.pipeline").run}


def oracle_sql() -> dict[str, str]:
    out = {}
    for module, name in OPERATORS.items():
        sql = getattr(importlib.import_module(f"tessera.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
