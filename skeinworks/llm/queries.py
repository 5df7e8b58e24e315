"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from skeinworks.llm import (
    exact_dedup,
    fill_in_middle,
    filter_audit,
    fuzzy_lines,
    merkle,
    mixing,
    packing,
    passages,
    pseudonyms,
    quality_rules,
    rule_ensemble,
    simhash,
    toxicity,
)

QUERIES = {
    "op1_repeated_passages": passages.query,
    "op2_quality_rules": quality_rules.query,
    "op3_pseudonyms": pseudonyms.query,
    "op4_fuzzy_lines": fuzzy_lines.query,
    "op5_toxic_spans": toxicity.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_source_mixing": mixing.query,
    "op8_merkle_fingerprints": merkle.query,
    "op9_packing": packing.query,
    "op10_rule_ensemble": rule_ensemble.query,
    "op11_filter_audit": filter_audit.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_exact_dedup": exact_dedup.query,
}
ORACLE = {
    "op7_source_mixing": mixing.SQL,
    "op8_merkle_fingerprints": merkle.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
