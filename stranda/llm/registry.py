"""The subpackage's queries and SQL, as __spark_entry__ takes them."""

from . import op1_rules, op2_kdtree, op3_language, op4_ngram_join, op5_chat, op6_decontaminate, op7_licenses, op8_pii, op9_html, op10_packing, op11_runs, op12_lz, op13_trie

_MODULES = (op1_rules, op2_kdtree, op3_language, op4_ngram_join, op5_chat, op6_decontaminate, op7_licenses, op8_pii, op9_html, op10_packing, op11_runs, op12_lz, op13_trie)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLES", {}).items()}
