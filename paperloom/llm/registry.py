"""The queries of this subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from importlib import import_module

#: operator number: module, query name.
OPERATORS = {
    1: ("warc", "op1_warc_revisits"),
    2: ("ann", "op2_multi_index_hashing"),
    3: ("quality", "op3_quality"),
    4: ("line_dedup", "op4_line_dedup"),
    5: ("url_filter", "op5_url_templates"),
    6: ("chat", "op6_chat_windows"),
    7: ("media", "op7_media"),
    8: ("packing", "op8_packing"),
    9: ("mixing", "op9_mixing"),
    10: ("minhash", "op10_near_duplicates"),
    11: ("resample", "op11_importance_resampling"),
    12: ("trees", "op12_jaccard_join"),
    13: ("repair", "op13_conversation_repair"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, name in OPERATORS.values()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module, name in OPERATORS.values():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
