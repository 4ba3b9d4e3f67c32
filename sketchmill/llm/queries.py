"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, chat_format, decontaminate, html_extract, language_id, merkle, near_dedup, packing, pitman_yor, quality_crf, quality_rules, token_rollup, vector_search

QUERIES = {
    "op1_token_rollup": token_rollup.op1_token_rollup,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_consensus_extraction": html_extract.op3_consensus_extraction,
    "op4_quality_crf": quality_crf.op4_quality_crf,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_pitman_yor_lm": pitman_yor.op6_pitman_yor_lm,
    "op7_language_id": language_id.op7_language_id,
    "op8_vantage_point_search": vector_search.op8_vantage_point_search,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_risk_controlled_rules": quality_rules.op12_risk_controlled_rules,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}

ORACLES = {
    "op2_chat_format": chat_format.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op8_vantage_point_search": vector_search.ORACLE,
    "op10_minhash_near_dedup": near_dedup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_risk_controlled_rules": quality_rules.ORACLE,
    "op13_centroid_clustering": centroids.ORACLE,
}
