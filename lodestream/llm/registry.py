"""Queries of this subpackage, by name, and the reference SQL of those SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, langid, line_dedup, maxent_lm, mixing, near_dedup, periodic_runs, prefix_trie, quality_knn, quality_rules, sharding, url_filter

QUERIES = {
    "op1_quality_knn": quality_knn.op1_quality_knn,
    "op2_lm_score": maxent_lm.op2_lm_score,
    "op3_language_id": langid.op3_language_id,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_chat_rotation": chat.op6_chat_rotation,
    "op7_mixing": mixing.op7_mixing,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_url_filter": url_filter.op13_url_filter,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_chat_rotation": chat.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_url_filter": url_filter.OP13_SQL,
}
