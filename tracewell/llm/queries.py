"""Registered queries of the operators in this package, and the SQL that checks them where SQL can state it."""

from tracewell.llm import arc, curve_pack, decontaminate, html_blocks, mixing, neardup, prefix_trie, repair, rules, secret_scan, sharding, suffix_lm, zstd_quality

QUERIES = {
    "op1_arc_to_warc": arc.op1,
    "op2_benchmark_decontamination": decontaminate.op2,
    "op3_quality_rules": rules.op3,
    "op4_secret_scan": secret_scan.op4,
    "op5_near_duplicates": neardup.op5,
    "op6_compression_quality": zstd_quality.op6,
    "op7_main_text": html_blocks.op7,
    "op8_suffix_tree_lm": suffix_lm.op8,
    "op9_source_mix": mixing.op9,
    "op10_balanced_shards": sharding.op10,
    "op11_prefix_trie": prefix_trie.op11,
    "op12_conversation_repair": repair.op12,
    "op13_curve_packing": curve_pack.op13,
}

ORACLES = {
    "op1_arc_to_warc": arc.OP1_SQL,
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op5_near_duplicates": neardup.OP5_SQL,
    "op9_source_mix": mixing.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_conversation_repair": repair.OP12_SQL,
}
