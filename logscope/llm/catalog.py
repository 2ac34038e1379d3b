"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from logscope.llm import (
    bin_packing, hamming_search, html_wrappers, license_scan, private_data, quality_rules, simhash_dedup, source_mixing, substring_dedup, suffix_dedup,
    term_pipeline, turn_repair, weak_labels,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
    "op3_bin_packing": bin_packing.op3_bin_packing,
    "op4_weak_labels": weak_labels.op4_weak_labels,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_html_wrappers": html_wrappers.op7_html_wrappers,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_source_mixing": source_mixing.op9_source_mixing,
    "op10_hamming_search": hamming_search.op10_hamming_search,
    "op11_term_pipeline": term_pipeline.op11_term_pipeline,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_private_data": private_data.op13_private_data,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op9_source_mixing": source_mixing.SQL,
    "op10_hamming_search": hamming_search.SQL,
    "op11_term_pipeline": term_pipeline.SQL,
    "op12_turn_repair": turn_repair.SQL,
}
